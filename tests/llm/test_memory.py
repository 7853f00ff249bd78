"""Kernels give memory back between tasks."""

from nearledger import package


def test_a_worker_gives_memory_back_before_and_after_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(package, "ship", lambda spark: None)
    monkeypatch.setattr(package, "give_back", lambda: calls.append(1), raising=False)

    class Frame:
        sparkSession = None

        def mapInArrow(self, f, schema):
            return f

    assert list(package.mapped(Frame(), lambda batches: (2 * b for b in batches), "x long")([1, 2])) == [2, 4]
    assert len(calls) == 2
