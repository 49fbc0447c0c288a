"""A deterministic stand-in for a model, for the registered query and the tests."""

from __future__ import annotations

import json
from collections.abc import Callable


def extractive_stub() -> Callable[[list[str]], list[str]]:
    """Replies with a JSON object whose summary is the prompt's first line and
    whose needs are its first two words."""
    def call(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            first = (p or "").split("\n", 1)[0]
            out.append("```json\n" + json.dumps({"deep_needs": first.split()[:2], "summary": first},
                                                ensure_ascii=False) + "\n```")
        return out

    return call
