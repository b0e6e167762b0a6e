import gc
import tracemalloc
import weakref

import numpy as np

from candor.llm import shared
from candor.llm import sketch as S
from candor.llm.packing import WordIds
from candor.llm.queries import tokenizer_path


def test_what_a_task_remembers_goes_with_it():
    words = WordIds(tokenizer_path())
    words.encode("some words, remembered")
    words.encode("é́ other")
    held = [weakref.ref(x) for x in (words, words.words, words.plain, words.other)]
    gc.disable()
    try:
        del words
        assert [x() for x in held] == [None] * 4
    finally:
        gc.enable()


class Held:
    pass


def test_a_step_gives_back_when_its_own_values_are_gone(monkeypatch):
    held, told = [], []
    monkeypatch.setattr(shared, "give_back", lambda: told.append([x() is None for x in held]))

    @shared.giving_back
    def step(batches):
        own = Held()
        held.append(weakref.ref(own))
        yield from (2 * b for b in batches)

    assert list(step(iter([1, 2]))) == [2, 4] and told == [[True]]
    assert step.__name__ == "step" and "batches" in step.__wrapped__.__code__.co_varnames


def test_a_tasks_sketch_takes_little_more_than_its_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1 << 19, dtype=np.uint64)
    tracemalloc.start()
    S.partial(keys, 24)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 9 * keys.nbytes
