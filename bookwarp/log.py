"""Where the command line writes its log."""

from __future__ import annotations

import logging
from pathlib import Path

# The log's file and the form of its lines.
FILE = "library.log"
LINE = "%(asctime)s %(levelname)s %(message)s"


def log_to(folder: str | Path, level: int = logging.INFO) -> logging.Logger:
    """The package's logger, which writes to a file in the folder; asked again for a folder, it writes each line once."""
    target = Path(folder) / FILE
    target.parent.mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger("bookwarp")
    logger.setLevel(level)
    if str(target.absolute()) not in {getattr(h, "baseFilename", None) for h in logger.handlers}:
        handler = logging.FileHandler(target, encoding="utf-8", delay=True)
        handler.setFormatter(logging.Formatter(LINE))
        logger.addHandler(handler)
    return logger
