"""A small corpus with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import types as T

from marginalia.llm import quality

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("size", T.LongType()),
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def make_texts(seed=1, count=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéßñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = prose(60)
    texts = []
    for i in range(count):
        w = prose(r.choice([3, 9, 15, 40, 120, 300]))
        if i % 7 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        texts.append(" ".join(x + r.choice(["", "", "", "\n"]) for x in w))
    for i in range(0, count, 5):  # near copies: one word in some forty changed
        w = words(texts[i])
        for _ in range(max(1, len(w) // 40)):
            w[r.randrange(len(w))] = r.choice(vocabulary).upper()
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + [texts[4] + "\n"]
    texts += [None, "", "   \n\t ", "one", "one two", "a b c", "word " * 70, "x y  z 😀 \x85", "<|endoftext|> in a text", "% * & | < > # $ " * 30]
    texts.append(" ".join(prose(20000)))
    return texts


def make_rows(texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s1", None][i % 4], len(t or ""), -1, "r", "k", 0) for i, t in enumerate(texts)]
    rows.append((None, "a text without an id, of several words", "en", "s1", 1, -1, "r", "k", 0))
    rows.append(rows[8])  # a row repeated in full
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def components(rows, n, percent):
    """(doc_id, text) -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = []
    for r in rows:
        w = words(lowered(r[1]))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def without_repeats(rows, length):
    """(doc_id, words, words kept) by looking up every window."""
    count = {}
    split = [words(r[1]) for r in rows]
    for w in split:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            count[key] = count.get(key, 0) + 1
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((r[0], len(w), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def text_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def lines_kept(rows, min_chars=12):
    """doc_id -> text without later equal or near lines, for rows of distinct ids, in the order of ids."""
    first, kept = [], {}
    for doc_id, text in sorted(rows):
        out = []
        for line in (text or "").split("\n"):
            if not words(line):
                out.append(line)
                continue
            near = any(line == x or (len(line) >= min_chars and len(x) >= min_chars and one_edit(line, x)) for x in first)
            if not near:
                out.append(line)
            if line not in first:
                first.append(line)
        kept[doc_id] = "\n".join(out)
    return kept


def robust_distances(texts):
    """Squared distances of one group by concentration steps over whole arrays: ranks instead of bins of distances."""
    counts = np.array([text_counts(t) for t in texts], float)
    n = np.maximum(counts[:, :1], 1)
    raw = np.hstack((np.log((counts[:, 1:2] + 1) / n), np.log1p(100 * counts[:, 2:] / n)))
    x, ridge = np.round(raw * quality.GRAIN) / quality.GRAIN, np.diag(np.square(quality.RIDGE))
    size, results = int(np.ceil(quality.HALF * len(x))), []
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    for centre, scatter in ((x.mean(0), np.cov(x.T, bias=True) + ridge), (q2, np.diag(np.square((q3 - q1) / 1.349)) + ridge)):
        for step in range(5):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            near = x[np.argsort(d, kind="stable")[:size]]
            if step < 4:
                centre, scatter = near.mean(0), np.cov(near.T, bias=True) + ridge
        results.append((np.linalg.slogdet(scatter)[1], d / max(1.0, np.sort(d)[size - 1] / quality.CHI2_HALF)))
    return min(results, key=lambda r: r[0])[1]
