import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from stratiform.functions import vectors as V


def brute(rows, dims):
    sums = defaultdict(Counter)
    for key, text in rows:
        if key is not None:
            for w in re.findall("[a-z0-9_一-鿿]+", (text or "").lower()):
                h = hashlib.sha256(w.encode()).digest()
                sums[key][int.from_bytes(h[:4], "big") % dims] += -1 if h[4] % 2 else 1
    length = {k: math.sqrt(sum(v * v for v in s.values())) for k, s in sums.items()}
    return {(k, d): v / length[k] for k, s in sums.items() for d, v in s.items() if v}


def test_words_are_hashed_where_their_text_is(spark):
    rows = [("a", "One two one, TWO 三国 x_1"), ("a", "two more of the same key"), ("b", None), ("c", " .,; é "), (None, "no key"), ("d", "alone"), ("e", "İstanbul K ſ 龥鿿ꀀ " + "w " * 300)]
    rows += [(f"n{i}", " ".join(f"w{j * i % 97}" for j in range(60))) for i in range(300)]
    made = V.hashed_entries(spark.createDataFrame(rows, "k string, text string").repartition(3), "k", "text", 16)
    got = {(r.k, r.dim): r.value for r in made.collect()}
    assert got == pytest.approx(brute(rows, 16))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "sha2" not in plan  # no row of a word is made, and none shuffled
