"""The fill-in-middle transformation against a plain version, and its exact inverse."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from marginalia.llm import fill_middle
from marginalia.llm.fill_middle import fill_in_middle, restore
from tests.llm.corpus import SCHEMA, frame, make_rows, make_texts


def plain_version(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return len(units), form, len(p), len(m), out


def awkward():
    texts = make_texts()
    texts += ["<P>", "a <S> b", "<M", "<P<S<M", ">>><<<", "é" * 50, "aé" * 70, "A" * 3000, "\x00\n\r", "😀a😀", "P>S>M>"]
    r = random.Random(5)
    texts += ["".join(r.choice("aB<>PSM é😀\n") for _ in range(r.randint(0, 60))) for _ in range(400)]
    return make_rows(texts)


def test_every_row_equals_the_plain_version(spark):
    rows = awkward()
    made = fill_in_middle(frame(spark, rows), ("doc_id", "key", "n"))
    got = [(r["row"]["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_version(i, t)) for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_restoring_gives_the_texts_back(spark):
    rows = awkward()
    back = restore(fill_in_middle(frame(spark, rows), ("doc_id",), seed=7, rate=100)).select("row.doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t, *_ in rows), key=repr)


def test_restored_evades_a_column_of_its_name(spark):
    made = fill_in_middle(frame(spark, make_rows(["one two three four"] * 9)), ("doc_id",)).selectExpr("output", "form", "n as restored")
    assert restore(made).columns == ["output", "form", "restored", "_restored"]


def test_an_empty_table(spark):
    assert restore(fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_pieces_of_long_texts_meet(monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    r = random.Random(piece)
    for _ in range(200):
        text = "".join(r.choice("abZ é😀.<>") for _ in range(r.randint(1, 90)))
        data = np.frombuffer(text.encode(), np.uint8)
        units = [m.start() for m in re.finditer(r"(?s)[A-Za-z]+|[^A-Za-z]", text)]
        places = [len(text[:u].encode()) for u in units] + [len(data)]
        counts = fill_middle.count_units(data)
        assert sum(counts) == len(units)
        assert [fill_middle.unit_place(data, counts, k) for k in range(len(units) + 1)] == places
        a, b = sorted(r.choice(places) for _ in range(2))
        for form in ("psm", "spm"):
            out = bytes(fill_middle.arrange(text.encode(), a, b, form))
            p, m, s = text.encode()[:a], text.encode()[a:b], text.encode()[b:]
            assert out == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
            assert bytes(fill_middle.invert(out, form)) == text.encode()
