"""Task functions hand back freed memory once, when they end, whatever their shape."""
import pytest

from gridlake.llm import shared


def test_freed_memory_goes_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))

    @shared.given_back
    def batches(rows):
        yield from rows
        if not rows:
            raise ValueError

    rows = batches([1, 2])
    assert next(rows) == 1 and not calls
    assert list(rows) == [2] and len(calls) == 1
    with pytest.raises(ValueError):
        list(batches([]))
    assert len(calls) == 2
    assert shared.given_back(lambda a: a + 1)(1) == 2 and shared.given_back(lambda a, b: a + b)(1, 2) == 3 and len(calls) == 4


def test_give_back():
    shared.give_back()
