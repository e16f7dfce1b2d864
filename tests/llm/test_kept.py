"""What workers keep between tasks."""

import weakref

from riskbridge.llm import arrow


class Large:
    pass


def test_one_owner_at_a_time():
    made = [arrow.kept("tokens", Large) for _ in range(2)]
    assert made[0] is made[1]
    gone = weakref.ref(made[0])
    del made
    arrow.kept("language", Large)
    assert gone() is None and list(arrow._KEPT) == ["language"]
