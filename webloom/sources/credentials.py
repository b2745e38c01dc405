"""Keys and tokens from the environment, on the driver only; they never become a column."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable

from webloom.errors import MESSAGES, PipelineError

DEFAULT_MODEL = "gemini-2.5-flash"


class Secret:
    """A trimmed value that does not print."""

    def __init__(self, value: str):
        self._value = value.strip()

    def expose(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "[REDACTED]"

    __str__ = __repr__


def search_key(env=os.environ) -> tuple[Secret, str]:
    """The search key and the model, which a variable may replace."""
    if not env.get("GEMINI_API_KEY", "").strip():
        raise PipelineError.user(MESSAGES["search"]["ApiKeyNotSet"])
    return Secret(env["GEMINI_API_KEY"]), env.get("GEMINI_MODEL", "").strip() or DEFAULT_MODEL


def _helper() -> str | None:
    try:
        done = subprocess.run(["gh", "auth", "token"], capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def repo_token(env=os.environ, helper: Callable[[], str | None] = _helper) -> Secret | None:
    """The first of two variables that is set, else what the helper program says, else none."""
    for name in ("GITHUB_TOKEN", "GH_TOKEN"):
        if env.get(name, "").strip():
            return Secret(env[name])
    token = helper()
    return Secret(token) if token else None


def chat_token(env=os.environ) -> Secret:
    if not env.get("SLACK_TOKEN", "").strip():
        raise PipelineError.user(MESSAGES["chat"]["TokenNotSet"])
    return Secret(env["SLACK_TOKEN"])
