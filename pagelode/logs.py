"""The engine's log: to the console and to a file that is rotated."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler


def logger(name: str = "pagelode", path: str | None = None, level: int = logging.INFO, max_bytes: int = 10 * 1024 * 1024, backups: int = 5) -> logging.Logger:
    """A logger of this name; asked for again, it gets no second set of handlers."""
    out = logging.getLogger(name)
    out.setLevel(level)
    if not out.handlers:
        kinds: list[logging.Handler] = [logging.StreamHandler()]
        if path:
            kinds.append(RotatingFileHandler(path, maxBytes=max_bytes, backupCount=backups, encoding="utf-8"))
        for handler in kinds:
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            out.addHandler(handler)
    return out
