"""Advice from a plugged-in text source: reading its answers, plans and search hints made of them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from plumbline.operators import profile
from plumbline.plans.plan import Plan, RuleAdvisor

_REASONING = re.compile(r"<think>.*?(?:</think>|\Z)", re.S | re.I)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def parsed(answer: str | None) -> dict:
    """The JSON object of an answer, after blocks of reasoning and code fences are taken off; {} if there is none."""
    text = _REASONING.sub("", answer or "")
    fenced = _FENCE.search(text)
    text = fenced[1] if fenced else text
    start, end = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[start : end + 1]) if 0 <= start < end else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


class AskingAdvisor:
    """An ``Advisor`` that asks ``ask`` (prompt to answer) for a plan; where no plan can be read, ``fallback`` makes it."""

    def __init__(self, ask: Callable[[str], str], fallback: RuleAdvisor | None = None):
        self.ask, self.fallback = ask, fallback or RuleAdvisor()

    def plan(self, df: DataFrame, task: str, target: str | None = None) -> Plan:
        prompt = json.dumps({"task": task, "target": target, "profile": profile.summary(df)}, default=str)
        answer = parsed(self.ask(prompt))
        return Plan.from_contract(answer) if answer else self.fallback.plan(df, task, target)

    def parameters(self, model: str, facts: dict) -> dict:
        """Parameters that the source proposes for a model, {} without an answer."""
        return parsed(self.ask(json.dumps({"model": model, "facts": facts}, default=str)))


#: Priorities of columns, the most important first.
PRIORITIES = ("high", "medium", "low")


def kept_by_priority(columns: list[dict], most: int = 5) -> list[dict]:
    """The ``most`` kept columns (``name``, ``priority``, ``keep``) of highest priority; unknown priorities last, ties in order."""
    place = {p: i for i, p in enumerate(PRIORITIES)}
    kept = [c for c in columns if c.get("keep", True)]
    return sorted(kept, key=lambda c: place.get(str(c.get("priority", "")).lower(), len(PRIORITIES)))[:most]
