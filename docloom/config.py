"""Verbose reporting, through the standard logging module."""

from __future__ import annotations

import logging

log = logging.getLogger("docloom")


def set_verbose(on: bool = True, stream=None) -> None:
    for handler in list(log.handlers):
        log.removeHandler(handler)
    if on:
        log.addHandler(logging.StreamHandler(stream))
    log.setLevel(logging.INFO if on else logging.WARNING)
