"""What a worker holds at once."""

from types import SimpleNamespace

from roadweft.llm import tokens


def test_library_calls_are_bounded_and_keep_the_order():
    calls = []

    class Library:
        def encode_batch_fast(self, texts, add_special_tokens):
            calls.append(texts)
            return [SimpleNamespace(ids=[len(t)]) for t in texts]

    encoder = tokens.Encoder.__new__(tokens.Encoder)
    encoder.tokenizer = Library()
    texts = ["x" * (k % 50) for k in range(10_000)] + ["y" * tokens.CALL_CHARS] * 3 + ["z"]
    assert encoder._library(texts) == [len(t).to_bytes(4, "little") for t in texts]
    assert len(calls) > 5 and all(len(c) <= tokens.CALL_CHUNKS and sum(map(len, c[:-1])) < tokens.CALL_CHARS for c in calls)
    assert encoder._library([]) == []


def test_packings_know_their_fill_and_leave_shared_sequences_alone():
    import random

    from roadweft.llm import packing

    rng = random.Random(2)
    sizes = [rng.randrange(1, 900) for _ in range(400)]
    a, b = (packing.best_fit(rng.sample(range(400), 400), sizes, 2048) for _ in range(2))
    before = [[list(s) for s in p] for p in (a, b)]
    for child in (packing.crossover(a, b, sizes, 2048, rng), packing.mutate(a, sizes, 2048, rng)):
        assert sorted(i for s in child for i in s) == list(range(400))
        assert all(s.fill == sum(sizes[i] for i in s) <= 2048 for s in child)
        assert any(s is t for s in child for t in [*a, *b])  # untouched ones aren't copied
    assert [[list(s) for s in p] for p in (a, b)] == before
