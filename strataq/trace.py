"""Leveled tracing by component on top of logging; levels and components come from STRATAQ_TRACE, e.g. "QUERY=DEBUG,CACHE=INFO"."""

from __future__ import annotations

import json
import logging
import os

LEVELS = {"OFF": 100, "ERROR": logging.ERROR, "WARN": logging.WARNING, "INFO": logging.INFO, "DEBUG": logging.DEBUG, "VERBOSE": 5}


class Tracer:
    def __init__(self, setting: str | None = None):
        setting = os.environ.get("STRATAQ_TRACE", "") if setting is None else setting
        self.levels = {}
        for part in filter(None, setting.split(",")):
            component, _, level = part.partition("=")
            self.levels[component.upper()] = LEVELS[level.upper() or "INFO"]

    def enabled(self, component: str, level: str) -> bool:
        return LEVELS[level] >= self.levels.get(component, self.levels.get("ALL", LEVELS["OFF"]))

    def log(self, component: str, level: str, message: str, **facts) -> None:
        if self.enabled(component, level):
            logging.getLogger(f"strataq.{component.lower()}").log(LEVELS[level], "%s %s", message, json.dumps(facts, default=str))
