import io
import logging

from tidemark.functions.log import NAME, configure_logging


def test_silent_by_default_and_root_untouched():
    assert any(isinstance(h, logging.NullHandler) for h in logging.getLogger(NAME).handlers)
    before = list(logging.getLogger().handlers)
    configure_logging(stream=io.StringIO())
    assert logging.getLogger().handlers == before


def test_levels_and_one_handler():
    first, second = io.StringIO(), io.StringIO()
    other = logging.StreamHandler(io.StringIO())
    logging.getLogger(NAME).addHandler(other)
    configure_logging(stream=first)
    logger = configure_logging(verbose=True, stream=second)
    logging.getLogger(f"{NAME}.x").debug("seen")
    assert first.getvalue() == "" and "seen" in second.getvalue() and other in logger.handlers
    configure_logging(stream=second)
    logging.getLogger(f"{NAME}.x").debug("unseen")
    assert "unseen" not in second.getvalue()
    logger.removeHandler(other)
