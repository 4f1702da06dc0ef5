"""Package logging: silent until asked for, and never touching the root logger."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

NAME = "tidemark"
logging.getLogger(NAME).addHandler(logging.NullHandler())
_own: logging.Handler | None = None


def configure_logging(verbose: bool = False, stream: TextIO | None = None) -> logging.Logger:
    """Log to a stream, at INFO or (verbose) DEBUG; a second call replaces the handler of the first one only."""
    global _own
    logger = logging.getLogger(NAME)
    if _own is not None:
        logger.removeHandler(_own)
    _own = logging.StreamHandler(stream or sys.stderr)
    _own.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logger.addHandler(_own)
    logger.setLevel(logging.DEBUG if verbose else logging.INFO)
    return logger
