"""What Python workers keep between tasks."""

import re

import numpy as np

from headway.llm import subwords, workers
from headway.llm.queries import vocabulary


def own_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(n) for n in re.findall(r"\n(?:Private_Dirty|Shared_Dirty):\s+(\d+)", f.read())) / 1024


def test_other_steps_drop_the_tokenizer():
    list(workers.frugal(lambda b: b, subwords.KEPT_AS)(iter([])))
    first = subwords.encoder(vocabulary())
    list(workers.frugal(lambda b: b, subwords.KEPT_AS)(iter([])))
    assert subwords.encoder(vocabulary()) is first
    list(workers.frugal(lambda b: b)(iter([])))
    assert not workers.KEPT


def test_a_step_leaves_no_freed_memory():
    last = []

    def step(batches):
        for n in batches:
            # Arrays of a size that the allocator keeps, between small ones that stay.
            many = []
            for _ in range(n):
                many.append(np.ones(12_000))
                last.append(np.ones(200))
            yield len(many)

    before = own_mb()
    assert list(workers.frugal(step)(iter([1500]))) == [1500]
    assert own_mb() - before < 60
