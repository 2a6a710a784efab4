"""op5: what the transducer's states take, and what happens when they run out."""

import random
import tracemalloc

import numpy as np
import pytest

from seriesmill.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words(n, seed=5):
    rng = random.Random(seed)
    some = ["ver", "th", "an", "ess", "qu", "é", "kel", "ñor", "ing", "st", "ou", "la", "ß", "mi", "gar", "世", "́", "x"]
    return ["".join(rng.choice(some) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_a_state_takes_little_memory():
    """Before, a state took about 2 KB, so 150,000 were all that fitted, and tasks made the same ones again and again."""
    own = bpe.Codec(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), public_tokenizers.PATTERN, 10**6, 1)
    own.encode(" ".join(words(1000, seed=1)))  # edges of most tokens are known
    before = len(own.transducer.states)
    many = words(20_000)
    tracemalloc.start()
    own.encode(" ".join(many))
    own.memory.clear()
    taken, made = tracemalloc.get_traced_memory()[0], len(own.transducer.states) - before
    tracemalloc.stop()
    assert made > 5000 and taken / made < 900


@pytest.mark.parametrize("most", [2, 7, 300])
def test_any_bound_on_states_gives_the_same_ids(most):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    own, lib = bpe.Codec(ranks, public_tokenizers.PATTERN, most, 1000), library(ranks)
    texts = [" ".join(words(60, seed)) for seed in range(12)] + ["".join(words(300, 99)), "  ".join(words(50, 98)), "\t" + " \n".join(words(50, 97)), "aaaa" * 300, "aaaa" * 299 + "b", ""]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert ids.tolist() == lib.encode_ordinary(text)
        assert np.array_equal(ids, own.encode(text))
    assert len(own.transducer.states) <= most
