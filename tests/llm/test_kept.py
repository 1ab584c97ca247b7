"""What Python workers keep from task to task."""

from factgrid.llm import common


def test_workers_forget_what_a_task_did_not_use():
    made = []

    @common.kept(1)
    def large():
        made.append(1)
        return bytearray(1000)

    large()
    common.give_back()
    large()
    common.give_back()
    assert len(made) == 1  # two tasks of one kind
    common.give_back()  # a task of another kind
    assert large.cache_info().currsize == 0
    large()
    common.give_back()
    large()
    assert len(made) == 2
