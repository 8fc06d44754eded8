"""Masks grow in all slices of the table."""

import itertools

import __spark_entry__ as entry


def test_more_than_32_slices(rows, spark, tmp_path):
    n = 40 * 64
    label = [2 if i % 97 == 0 or i == n - 1 else 1 for i in range(n)]
    rows([(i, [0.0], k) for i, k in enumerate(label)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set()
    for i in (i for i in range(n) if label[i] == 2):
        for o in itertools.product((-1, 0, 1), repeat=3):
            at = (i % 8 + o[0], i // 8 % 8 + o[1], i // 64 + o[2])
            if all(0 <= a < k for a, k in zip(at, (8, 8, 40))):
                want.add(at)
    got = [(r.x, r.y, r.z) for r in entry.queries()["mask_dilate"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(z for _, _, z in got) == 39
