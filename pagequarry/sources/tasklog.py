"""Log lines of sources, which name the task that they belong to."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

_TASK: ContextVar[tuple[str, str]] = ContextVar("task", default=("-", "-"))


@contextmanager
def task(task_id: object, kind: str) -> Iterator[None]:
    """Within it, log lines carry the task's id and kind."""
    token = _TASK.set((str(task_id), kind))
    try:
        yield
    finally:
        _TASK.reset(token)


class _Log(logging.LoggerAdapter):
    def process(self, msg, kwargs):
        task_id, kind = _TASK.get()
        kwargs["extra"] = {**(kwargs.get("extra") or {}), "task_id": task_id, "task_type": kind}
        return f"[{kind} {task_id}] {msg}", kwargs


log = _Log(logging.getLogger("pagequarry.source"), {})
