import random

import numpy as np
import pyarrow as pa
from conftest import WORDS

from razao.llm.words import Words, normal_form, repeats, slices, sliding_min

ALPHABET = "ab é\n\t\x0b Z\U0001f600"


def texts(rnd):
    return [
        None if rnd.random() < 0.1 else "".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60)))
        for _ in range(rnd.randint(1, 8))
    ]


def test_words_windows_and_lines_equal_plain_python():
    rnd = random.Random(1)
    for _ in range(200):
        given = texts(rnd)
        words = Words(pa.array(given, pa.string()))
        plain = [WORDS.findall(t or "") for t in given]
        flat = [w for of in plain for w in of]
        assert [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)] == flat
        assert words.count.tolist() == [len(w) for w in plain]
        assert words.word_chars().tolist() == [sum(map(len, w)) for w in plain]
        form, bounds = normal_form(words)
        assert form.tobytes().decode() == "".join(w + " " for w in flat) and bounds[-1] == len(form)
        for n in (1, 2, 3, 5, 20):
            at, key = words.windows(n)
            want = [tuple(w[i : i + n]) for w in plain for i in range(len(w) - n + 1)]
            names = {}
            assert len(at) == len(want)
            assert all(names.setdefault(w, k) == k for w, k in zip(want, key.tolist()))
            assert len(set(names.values())) == len(names)
        text, start, end = words.lines()
        got = [(int(t), bytes(words.data[a:b]).decode()) for t, a, b in zip(text, start, end)]
        assert got == [(i, x) for i, t in enumerate(given) for x in (t or "").split("\n") if WORDS.search(x)]


def test_equal_words_hash_alike_in_any_block():
    long = "x " * 700_000 + "word"
    words = Words(pa.array([long, "word x"]))
    assert words.hash[-3] == words.hash[-2] and words.hash[0] == words.hash[-1]


def test_repeats_and_sliding_min():
    keys = np.array([5, 3, 5, 5, 9], np.uint64)
    again, later = repeats(keys)
    assert again.tolist() == [True, False, True, True, False] and later.tolist() == [False, False, True, True, False]
    x = np.array([4, 2, 7, 1, 9, 3])
    for n in range(1, 7):
        assert sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]


def test_slices_cover_the_batch_and_bound_bytes():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["a" * 10, None, "", "b" * 50, "c" * 5])})
    parts = list(slices(batch, "t", 20))
    assert [p.num_rows for p in parts] == [3, 1, 1]
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
