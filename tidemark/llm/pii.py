r"""PII surrogates: keyed, type-consistent replacements, with DataFrame functions only.

Entities are e-mail addresses, IP addresses (4 and 6), phone numbers, payment
cards that begin like a network's and pass the Luhn test, IBANs that pass their check, social security
numbers, access keys, assigned secrets, and names: words after a form of address or
a known given name, and every further mention of these words in the same text.

An entity is made of parts: an address of its local part and its domain, a name
of its words, any other of itself.  A part is keyed on its canonical form (case
folded, digits without punctuation), drawn from a keyed hash, and written in
the format that was seen; so "Alice@Corp.com" and "alice@corp.com", or "+1 555-123-4567" and
"+15551234567", stay the same (coreference).  Surrogates keep length, case,
script and punctuation; card numbers their network and the Luhn test, IBANs
their country and check, phones the country code, addresses the top-level
domain, secrets the kinds of their characters.  Given names become given names
of the same gender and script, family names family names.

No two parts of a kind share a surrogate, and none is a part of the input
(distinctness): candidates are checked against each other, against those given
and against all originals, and losers draw again, names from compounds of ever
more list names, others growing by digits after ``WIDEN`` draws.  As parts map one to one,
so do entities.  A surrogate depends on the key and its part alone, but where
two parts drew the same one: then on which others are in the run.

Scale: rounds run over distinct parts, written to the shared folder; only texts
with entities are shuffled (``sieve.py``), to meet their surrogates; a hot
part skews a sort-merge join that adaptive execution splits.

Defined results: null text stays null; texts without entities are unchanged;
rows repeating id and text get the same result; extra columns are kept, and the
count of entities gets another name if one of them is called like it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged
from tidemark.llm.sieve import fresh, held, sieve

WIDEN = 6

# Forms of address by gender, given names by gender and script, parts of family names, character classes.
TITLES = {
    "m": "Mr|Mister|Herr|Monsieur|Señor|Sr|Господин|г-н",
    "f": "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|Srta|Госпожа|г-жа",
    "": "Dr|Doctor|Prof|Professor|Doktor|Docteur",
}
GIVEN = {
    ("f", "latin"): "Anna Maria Elena Laura Sofia Julia Emma Clara Marta Lucia Ingrid Karin Sabine Ursula Monique Camille Chloé Amélie Carmen Pilar Isabel Teresa Emily Olivia Charlotte Hannah Sarah Rachel Linda Susan Katherine Alice",
    ("m", "latin"): "John James Robert Michael William David Thomas Peter Paul Daniel Martin Stefan Andreas Klaus Jürgen Wolfgang Pierre François Antoine Étienne Carlos Miguel Javier Diego Antonio Marco Luca George Henry Edward Oliver Samuel",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική",
    ("m", "greek"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης",
}
GIVEN = {k: v.split() for k, v in GIVEN.items()}
_STEMS = {"latin": "Lind Holm Stein Wald Brook Ash Hart West North Feld Rosen Gold Silver Black White Green Stone Wood Hill Win", "cyrillic": "Иван Петр Сидор Кузнец Смирн Волк Лебед Орл Медвед Морозк", "greek": "Γεωργ Νικολα Δημητρ Κωνσταντιν Βασιλε Αθανασ"}
_ENDINGS = {("m", "latin"): "man berg son ford ley ton well field", ("f", "latin"): "man berg son ford ley ton well field", ("m", "cyrillic"): "ов", ("f", "cyrillic"): "ова", ("m", "greek"): "ίδης", ("f", "greek"): "ίδου"}
FAMILY = {(g, s): [stem + end for stem in _STEMS[s].split() for end in ends.split()] for (g, s), ends in _ENDINGS.items()}
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
#: Country codes of phone numbers.
CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: How card numbers of the networks begin.
NETWORK = r"^(?:4|5[0-8]|3[04-9]|6[0-57]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720))"

_WORD = r"\p{Lu}[\p{L}'-]+"
_TITLE = "|".join(TITLES.values())
_GIVEN = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)))
_BARE = r"[A-Za-z0-9_/+.=-]{5,}[A-Za-z0-9_/+=-]"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,63})(?![A-Za-z0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]++)(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9])(?i:token|password|passwd|secret|api[_-]?key)\s{{0,3}}(?:=\s{{0,3}}[\"']?{_BARE}|:\s{{0,3}}[\"']{_BARE}|:\s{{0,3}}(?=[A-Za-z_/+.=-]*[0-9]){_BARE})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z.+-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4})(?![0-9A-Za-z-])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}}|г-)(?:(?:{_TITLE})\.? {_WORD}(?: {_WORD}){{0,3}}|(?:{_GIVEN})(?: {_WORD}){{1,2}})",
}
#: All begin after what is no ASCII letter or digit, which is told first, for speed.
ANY = rf"(?<![A-Za-z0-9])(?:{'|'.join(PATTERNS.values())})"
#: What stands before an assigned secret, and stays.
ASSIGNED = r"^(?i:token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
ADDRESS = rf"^(?:{_TITLE})\.? "
NUMBERS = ("phone", "card", "ssn")


def found(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(0))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one being the check digit."""
    n = F.length(digits)

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda a, b: a + b)


def iban_rest(iban: Column) -> Column:
    """An IBAN's remainder by 97, its first four characters last and letters as numbers; 1 if its check digits are right."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    each = F.transform(F.split(moved, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(each, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)


def kind_of(value: Column) -> Column:
    """The type of a match; null for a number that only looks like a card or an IBAN."""
    whole = {k: F.regexp_like(value, F.lit(rf"^(?:{PATTERNS[k]})$")) for k in PATTERNS if k != "secret"}
    out = F.when(whole["card"], F.when((luhn_sum(digits_of(value)) % 10 == 0) & F.regexp_like(value, F.lit(NETWORK)), "card")).when(whole["iban"], F.when(iban_rest(F.replace(value, F.lit(" "), F.lit(""))) == 1, "iban"))
    for k, test in whole.items():
        if k not in ("card", "iban"):
            out = out.when(test, k)
    return out.when(F.regexp_like(value, F.lit(ASSIGNED)), "secret")


def words_of(name: Column) -> Column:
    return F.split(F.regexp_replace(name, ADDRESS, ""), " ")


def script(word: Column) -> Column:
    return F.when(F.regexp_like(word, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(word, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def name_kinds(name: Column) -> Column:
    """(word, kind) of a name's words: given or family, gender, script."""
    words, title = words_of(name), F.regexp_extract(name, ADDRESS, 0)
    known = {g: [n for (own, _), names in GIVEN.items() if own == g for n in names] for g in "fm"}
    gender = F.when(F.regexp_like(title, F.lit(rf"^(?:{TITLES['m']})\b")), "m").when(F.regexp_like(title, F.lit(rf"^(?:{TITLES['f']})\b")), "f")
    gender = gender.when(words[0].isin(known["f"]), "f").when(words[0].isin(known["m"]), "m").when(F.regexp_like(words[0], F.lit("[aаαη]$")), "f").otherwise("m")

    def kind(w: Column, i: Column) -> Column:
        given = (i < F.size(words) - 1) | (F.size(words) == 1) & w.isin(known["f"] + known["m"])
        family = F.when(script(w) == "latin", "m").when(F.regexp_like(w, F.lit("(а|ая|ου)$")), "f").otherwise("m")
        return F.struct(w.alias("word"), F.when(given, F.concat(F.lit("given_"), gender, F.lit("_"), script(w))).otherwise(F.concat(F.lit("family_"), family, F.lit("_"), script(w))).alias("kind"))

    return F.transform(words, kind)


def parts_of(kind: Column, value: Column, known: Column) -> Column:
    """(kind, canon) of an entity's parts, in order. known: the kinds of name words in its text."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)

    def part(k: str | Column, canon: Column) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), canon.alias("canon"))

    number = F.concat(F.when(F.startswith(value, F.lit("+")), "+").otherwise(""), digits_of(value))
    canon = F.when(kind.isin(*NUMBERS), number).when(kind == "ipv6", F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
    canon = canon.when(kind == "secret", F.regexp_replace(value, ASSIGNED, "")).otherwise(value)
    named = F.transform(F.when(kind == "name", words_of(value)).otherwise(F.array(value)), lambda w: part(F.element_at(known, F.lower(w)), F.lower(w)))
    return F.when(kind == "email", F.array(part("local", F.lower(local)), part("domain", F.lower(labels)))).when(kind.isin("name", "mention"), named).otherwise(F.array(part(kind, canon)))


# --- drawing ---


def stream(key: str, kind: Column, canon: Column, attempt: int) -> Column:
    """256 keyed bytes, in hexadecimal."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, F.lit(str(attempt)), canon)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}\x1f"), seed).cast("binary"), 512) for i in range(4)])


def number(bytes_: Column, at: Column | int, below: int) -> Column:
    """The at-th number drawn, less than below."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.conv(F.substring(bytes_, (at * 4) % 504 + 1, F.lit(8)), 16, 10).cast("long") % below).cast("int")


def redrawn(value: Column, bytes_: Column, classes: list[str]) -> Column:
    """value, each character drawn anew from its class; others stay."""

    def draw(c: Column, i: Column) -> Column:
        out = F.when(F.lit(False), c)
        for own in classes:
            out = out.when(F.instr(F.lit(own), c) > 0, F.substring(F.lit(own), number(bytes_, i, len(own)) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), draw), "")


def candidate(kind: Column, canon: Column, own: Column, attempt: int) -> Column:
    """What a part draws, from its bytes, at its attempt-th try."""
    letters, digits = [*CLASSES, "0123456789"], ["0123456789"]
    drawn = redrawn(canon, own, letters)
    code = F.regexp_extract(canon, CODE, 0)
    phone = F.concat(code, redrawn(F.substring(canon, F.length(code) + 1, F.length(canon)), own, ["01", "23456789"]))
    body = F.concat(F.substring(canon, 1, 4), F.substring(redrawn(canon, own, digits), F.lit(5), F.length(canon) - 5))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    ssn = F.concat((number(own, 0, 565) + 101).cast("string"), F.lpad((number(own, 1, 99) + 1).cast("string"), 2, "0"), F.lpad((number(own, 2, 9999) + 1).cast("string"), 4, "0"))
    account = redrawn(F.substring(canon, F.lit(5), F.length(canon)), own, ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"])
    checked = F.lpad((98 - iban_rest(F.concat(F.substring(canon, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (number(own, i, 254) + 1).cast("string")), ".")
    ipv6 = redrawn(canon, own, ["0", "123456789abcdef"])
    head = F.regexp_extract(canon, r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|eyJ)", 0)
    access = F.concat(head, redrawn(F.substring(canon, F.length(head) + 1, F.length(canon)), own, ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"]))
    secret = drawn
    for hexadecimal in ("0123456789abcdef", "0123456789ABCDEF"):
        secret = F.when(F.regexp_like(canon, F.lit(f"^[{hexadecimal}]+$")), redrawn(canon, own, [hexadecimal])).otherwise(secret)
    out = F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "iban", F.concat(F.substring(canon, 1, 2), checked, account)).when(kind == "ip", ip).when(kind == "ipv6", ipv6)
    out = out.when(kind == "key", access).when(kind == "secret", secret)
    for what, lists in (("given", GIVEN), ("family", FAMILY)):
        for (gender, written), names in lists.items():
            listed = F.array(*map(F.lit, names))
            some = [F.get(listed, number(own, i, len(names))) for i in range(1 + attempt // 2)]
            out = out.when(kind == f"{what}_{gender}_{written}", F.concat_ws("-", *some))
    if attempt < WIDEN:
        return out.otherwise(drawn)
    more = F.lpad(number(own, 61, 10 ** min(4 + attempt - WIDEN, 9)).cast("string"), 5 + attempt - WIDEN, "0")
    return F.when(kind.isin("local", "domain", "secret", "key"), F.concat(drawn, more)).when(kind.isin("phone"), F.concat(out, more)).otherwise(out.otherwise(drawn))


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct parts (kind, canon); one to one within a kind, and disjoint from the originals, in any case."""
    originals = staged(parts.distinct())
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = originals.select("kind", F.lower("canon").alias("low"))
    pending, given, attempt = originals, None, 0
    while True:
        # Bytes are drawn once, and then dealt to all tasks.
        bytes_ = pending.withColumn("bytes", stream(key, F.col("kind"), F.col("canon"), attempt)).repartition(tasks, "kind", "canon")
        drawn = staged(bytes_.select("kind", "canon", candidate(F.col("kind"), F.col("canon"), F.col("bytes"), attempt).alias("surrogate")))
        low = drawn.withColumn("low", F.lower("surrogate"))
        free = low.join(taken, ["kind", "low"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", F.lower("surrogate").alias("low")), ["kind", "low"], "left_anti")
        won = free.groupBy("kind", "low").agg(F.min(F.struct("canon", "surrogate")).alias("w")).select("kind", "w.canon", "w.surrogate")
        given = staged(won if given is None else given.unionAll(won))
        pending = staged(drawn.join(given, ["kind", "canon"], "left_anti").select("kind", "canon"))
        if pending.isEmpty():
            return given
        attempt += 1


# --- writing ---


def filled(seen: Column, chars: Column, kept: str) -> Column:
    """seen, its characters of a class replaced by chars in order; what is over goes last."""
    count = F.length(F.regexp_replace(seen, f"[^{kept}]", ""))

    def put(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(seen, F.lit(1), i), f"[^{kept}]", ""))
        return F.when(F.regexp_like(c, F.lit(f"^[{kept}]$")), F.substring(chars, before + 1, F.lit(1))).otherwise(c)

    return F.concat(F.array_join(F.transform(F.split(seen, ""), put), ""), F.substring(chars, count + 1, F.length(chars)))


def cased(seen: Column, new: Column) -> Column:
    """new with capitals where seen has them."""
    return F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.regexp_like(F.substring(seen, i + 1, F.lit(1)), F.lit(r"^\p{Lu}$")), F.upper(c)).otherwise(c)), "")


def written(kind: Column, value: Column, new: Column) -> Column:
    """An entity with its parts' surrogates (new), in the format that it was seen in."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.concat(cased(local, new[0]), F.lit("@"), cased(domain, new[1]), F.regexp_extract(domain, r"\.[^.]*$", 0))
    name = F.array_join(F.zip_with(words_of(value), new, lambda w, n: F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(n)).otherwise(n)), " ")
    out = F.when(kind == "email", email).when(kind.isin(*NUMBERS), filled(value, digits_of(new[0]), "0-9")).when(kind == "iban", filled(value, new[0], "A-Z0-9")).when(kind == "ipv6", F.when(F.lower(value) == value, new[0]).otherwise(F.upper(new[0])))
    return out.when(kind == "secret", F.concat(F.regexp_extract(value, ASSIGNED, 0), new[0])).when(kind.isin("name", "mention"), F.concat(F.regexp_extract(value, ADDRESS, 0), name)).otherwise(new[0])


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with surrogates in the text, and n_entities: how many places were replaced."""
    if not key:
        raise ValueError("surrogates need a secret key")
    keyed = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.xxhash64(f"`{text_col}`").alias("th"), F.col(f"`{text_col}`").alias("text"))
    own = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    first = keyed.select("id", "th", F.posexplode(found(F.col("text"), F.lit(ANY))).alias("at", "value")).withColumn("kind", kind_of(F.col("value"))).where("kind is not null")
    first = staged(first.distinct())
    # Words of names, by text, and the pattern that finds their further mentions.
    words = first.where("kind = 'name'").select("id", "th", F.explode(name_kinds(F.col("value"))).alias("w")).groupBy("id", "th", "w.word").agg(F.max("w.kind").alias("kind"))
    low = words.groupBy("id", "th", F.lower("word").alias("low")).agg(F.max("kind").alias("kind"), F.collect_set("word").alias("seen"))
    named = low.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.map_from_entries(F.collect_list(F.struct("low", "kind"))).alias("known"), F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"))
    again = F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), F.array_join(F.reverse("seen"), "|"), F.lit(r")(?![\p{L}])"))
    named = staged(named.select("_id", "_th", "known", again.alias("pattern")))
    some = sieve(named.select(F.xxhash64("_id", "_th")))
    texts = held(keyed, F.xxhash64("id", "th"), some).join(named.hint("merge"), own).select("id", "th", "text", "known", "pattern").dropDuplicates(["id", "th"])
    second = texts.select("id", "th", "known", F.posexplode(found(F.col("text"), F.col("pattern"))).alias("at", "value")).withColumn("kind", F.coalesce(kind_of(F.col("value")), F.when(F.map_contains_key("known", F.lower("value")), "mention")))
    columns = ["id", "th", "at", "value", "kind", "known"]
    plain = first.join(named.select("_id", "_th").hint("merge"), own, "left_anti").withColumn("known", F.lit(None).cast("map<string,string>")).select(columns)
    places = staged(plain.unionAll(second.where("kind is not null").select(columns)).withColumn("parts", parts_of(F.col("kind"), F.col("value"), F.col("known"))).drop("known"))
    given = surrogates(places.select(F.explode("parts").alias("p")).select("p.kind", "p.canon"), key)
    # Every part meets its surrogate, and then its entity, and then its text.
    asked = places.select("id", "th", "at", "value", F.col("kind").alias("whole"), F.posexplode("parts").alias("n", "p")).select("id", "th", "at", "value", "whole", "n", "p.kind", "p.canon")
    met = asked.join(given.hint("merge"), ["kind", "canon"]).groupBy("id", "th", "at", "value", "whole").agg(F.array_sort(F.collect_list(F.struct("n", "surrogate"))).alias("new"))
    done = met.select("id", "th", "at", written(F.col("whole"), F.col("value"), F.col("new.surrogate")).alias("text"))
    ids, ths, news, patterns = (fresh(n, docs.columns) for n in ("_ids", "_ths", "_news", "_pattern"))
    by_text = done.groupBy("id", "th").agg(F.map_from_entries(F.collect_list(F.struct("at", "text"))).alias(news))
    by_text = by_text.join(named.select("_id", "_th", "pattern").hint("merge"), own, "left").select(F.col("id").alias(ids), F.col("th").alias(ths), news, F.coalesce("pattern", F.lit(ANY)).alias(patterns))
    by_text = staged(by_text)
    touched = sieve(by_text.select(F.xxhash64(ids, ths)))
    hashed = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.xxhash64(f"`{text_col}`"))
    joined = held(docs, hashed, touched).join(by_text.hint("merge"), F.col(f"`{id_col}`").cast("string").eqNullSafe(F.col(ids)) & (F.xxhash64(f"`{text_col}`") == F.col(ths)), "left")
    text, pattern = F.col(f"`{text_col}`"), F.coalesce(F.col(patterns), F.lit(ANY))
    new = F.transform(found(text, pattern), lambda v, i: F.coalesce(F.element_at(F.col(news), i), v))
    whole = F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    whole = F.when(F.col(news).isNull(), text).otherwise(whole)
    count = fresh("n_entities", docs.columns)
    replaced_ = joined.select(*[whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.size(news), F.lit(0)).alias(count))
    return replaced_.unionAll(held(docs, hashed, touched, wanted=False).withColumn(count, F.lit(0)))
