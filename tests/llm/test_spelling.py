import collections
import random
import re
import zlib

import numpy as np

from innsight.llm import spelling

SCHEMA = "doc_id long, text string, word string, rank string, n string"  # clashing extra columns


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows):
    n = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            n[w] += len(w) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: sorted((v for v in n if one_apart(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] for w, v in near.items() if v and n[v[0]] >= 10 * n[w]}
    out = []
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out.append((w, form.get(w), r, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(spark, rows, parts=3):
    return sorted(map(tuple, spelling.query(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abé÷") for _ in range(rnd.randint(7, 9))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab"]

    def typo(w):
        i, c = rnd.randrange(len(w)), rnd.choice("abéz")
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w.upper() if w.isascii() else w])

    rows = [(i, rnd.choice([" ", "-", "Ā", "\n9"]).join(typo(w) if rnd.random() < 0.3 else w for w in rnd.choices(stems, k=rnd.randint(0, 40)))) for i in range(150)]
    rows += [(900 + i, " ".join(["chained"] * 40) + " chainedx" * (i < 20) + " chainedxy" * (i < 2)) for i in range(40)]  # forms of forms
    rows += [(1, None), (None, "nobodys nobodys nobodyz"), (2, ""), (3, "ok"), (4, "y" * 30_000 + " " + "y" * 29_999), (5, "y" * 30_000 + " " + "y" * 29_999)] + rows[:3]
    rows = [(i, t, "w", None, "n") for i, t in rows]
    want = brute(rows)
    assert got(spark, rows) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 3 for w in want)
    assert got(spark, rows[::-1], 7) == want
    assert got(spark, [], 1) == [] and got(spark, [(1, None, None, None, None), (2, "short words", None, None, None)]) == []


def test_groups_over_batches():
    """Groups that a batch cuts answer as whole ones do."""
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab") for _ in range(7)) for _ in range(60)})
    of, kind, h1, h2 = spelling.variants(words)
    rows = sorted(zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), kind.tolist(), of.tolist()))

    def run(size):
        total = collections.Counter()
        batches = (spelling.pa.RecordBatch.from_arrays([spelling.pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), ("int64", "int64", "int8", "int64"))], ["a", "b", "c", "d"]) for i in range(0, len(rows), size))
        for b in spelling._met(batches):
            for r, k, _ in zip(*[c.to_pylist() for c in b.columns]):
                total[r] += k
        return total

    want = {i: sum(one_apart(w, v) for v in words) for i, w in enumerate(words)}
    assert all(run(size) == {i: k for i, k in want.items() if k} for size in (1, 3, 50, 10_000))


def test_hashes_of_cut_texts():
    """A deletion's hash is the hash of the text that is left; equal neighbours give one deletion."""
    words = ["abc", "aab", "x"]
    of, kind, h1, h2 = spelling.variants(words)
    whole = {w: spelling.variants([w])[2][0] for w in ["bc", "ac", "ab"]}
    deletions = lambda i: set(h1[(of == i) & (kind == spelling.DELETION)].tolist())
    assert deletions(0) == {int(x) for x in whole.values()} and int(whole["ab"]) in deletions(1) and len(deletions(1)) == 2
