"""Repair of conversation structure by a grammar-compressed dynamic program.

A conversation is a sequence of symbols, one for each turn: its role's initial and its fault. The cheapest edits that
give the role initials ``(s?(ua)+)?`` follow from four states (nothing yet, after s, after u, after a): every symbol is a matrix
of the costs from state to state, with the edits as ropes of text, and matrices multiply by minimum and sum. Equally
cheap edits of one stretch are never prefixes of each other (they hold as many letters other than I, and an I
costs), so the least text of a product is the product of least texts.

Sequences repeat: distinct ones are evaluated once, and pairs of symbols that are frequent among them are replaced by rules
(Re-Pair, in rounds of several pairs). The rules' matrices are computed once, bottom-up, and shared by all sequences.
A sequence takes one character a turn, as its own audit does; texts are never gathered: turns are sorted by ranges, and the edits
are joined to them by their place in that order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import BLANKS, saved, ship

#: Role initials that count; all others are alike. Faults by number: none, truncated, blank, duplicate.
INITIALS = "sua"
TRUNCATED, BLANK, DUPLICATE = 1, 2, 3
FAULTS = 4
#: Edits and their costs (fixed values); an undeleted truncated turn costs MEND more.
REROLE, DELETE, INSERT, MEND = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Pairs of initials that may follow each other.
LEGAL = {"su", "ua", "au"}
#: Where an initial leads to from each state; the states that may be last.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES, ENDS = 4, (0, 3)
#: The first symbol of sequences, and of rules.
FIRST_SYMBOL, FIRST_RULE = 65, 0x100
#: Rounds of replacing pairs, pairs in a round. They decide the cost, not the result.
ROUNDS, PAIRS = 6, 24
#: Sequences with their results of up to so many bytes are broadcast.
BROADCAST_BYTES = 16 << 20
#: Edits in a batch.
BATCH = 4096


class Rope:
    """A text put together from two ropes, or a piece of text; joined when it is looked at."""

    __slots__ = ("_left", "_right", "_text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self._text, self._left, self._right = text, left, right

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = self._left.text + self._right.text
            self._left = self._right = None
        return self._text


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; of equal costs, the least text."""
    out: Matrix = []
    for row in a:
        made: list[Entry | None] = []
        for j in range(STATES):
            best = None
            for k in range(STATES):
                if row[k] is None or b[k][j] is None:
                    continue
                cost = row[k][0] + b[k][j][0]
                if best is None or cost < best[0] or cost == best[0] and row[k][1].text + b[k][j][1].text < best[1].text:
                    best = (cost, Rope(None, row[k][1], b[k][j][1]))
            made.append(best)
        out.append(made)
    return out


def _matrix(entries: dict[tuple[int, int], list[tuple[int, str]]]) -> Matrix:
    least = {at: min(choices) for at, choices in entries.items()}
    return [[(least[i, j][0], Rope(least[i, j][1])) if (i, j) in least else None for j in range(STATES)] for i in range(STATES)]


def _inserts() -> Matrix:
    """Any number of inserts: nothing, one, or two."""
    found: dict[tuple[int, int], list[tuple[int, str]]] = {(i, i): [(0, "")] for i in range(STATES)}
    for _ in range(2):
        for (i, k), choices in list(found.items()):
            for c in ROLES:
                if k in MOVES[c]:
                    found.setdefault((i, MOVES[c][k]), []).extend((cost + INSERT, text + "I") for cost, text in choices)
    return _matrix(found)


INSERTS = _inserts()


def symbol(initial: str, fault: int) -> str:
    return chr(FIRST_SYMBOL + FAULTS * (INITIALS.index(initial) if initial in tuple(INITIALS) else len(INITIALS)) + fault)


def _of(code: str) -> tuple[str, int]:
    """(initial, fault) of a symbol; an empty initial for other ones."""
    at = ord(code) - FIRST_SYMBOL
    return (INITIALS + " ")[at // FAULTS].strip(), at % FAULTS


def symbol_matrix(code: str) -> Matrix:
    """Inserts, then what may become of the turn."""
    initial, fault = _of(code)
    found: dict[tuple[int, int], list[tuple[int, str]]] = {(i, i): [(DELETE, "D")] for i in range(STATES)}
    if fault not in (BLANK, DUPLICATE):
        mend = MEND if fault == TRUNCATED else 0
        for c, letter, cost in ((initial, "K", 0), ("u", "R", REROLE), ("a", "R", REROLE)):
            for i, j in MOVES.get(c, {}).items():
                found.setdefault((i, j), []).append((cost + mend, letter))
    return times(INSERTS, _matrix(found))


class Grammar:
    """Rules by which pairs of symbols are replaced, in their order, and the matrices of all symbols."""

    def __init__(self, rules: list[str]) -> None:
        self.rules = {chr(FIRST_RULE + i): pair for i, pair in enumerate(rules)}
        self.matrices = {chr(FIRST_SYMBOL + i): symbol_matrix(chr(FIRST_SYMBOL + i)) for i in range(FAULTS * (len(INITIALS) + 1))}
        for name, pair in self.rules.items():
            self.matrices[name] = times(self.matrices[pair[0]], self.matrices[pair[1]])

    def compressed(self, sequence: str) -> str:
        for name, pair in self.rules.items():
            sequence = sequence.replace(pair, name)
        return sequence

    def _product(self, symbols: str) -> Matrix:
        """Halves first, so that a text is joined once for each level."""
        if len(symbols) == 1:
            return self.matrices[symbols]
        half = len(symbols) // 2
        return times(self._product(symbols[:half]), self._product(symbols[half:]))

    def repaired(self, sequence: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits."""
        found = times(self._product(self.compressed(sequence))[:1], INSERTS)[0] if sequence else INSERTS[0]
        return min((found[end][0], found[end][1].text) for end in ENDS if found[end] is not None)


def replay(sequence: str, audit: str) -> Iterator[tuple[str, str, str]]:
    """(roles inserted before, edit, new role) of each turn, roles by initial; at last those inserted at the end, with an empty edit."""
    state, before, turns = 0, "", iter(sequence)
    for edit in audit:
        if edit == "D":
            yield before, edit, ""
            next(turns)
            before = ""
            continue
        if edit == "K":
            role = _of(next(turns))[0]
            yield before, edit, ""
        else:
            role = "a" if state == 2 else "u"
            if edit == "R":
                next(turns)
                yield before, edit, role
            else:
                before += role
        if edit != "I":
            before = ""
        state = MOVES[role][state]
    yield before, "", ""


def _pairs(rules: list[str]):
    def run(batches):
        grammar = Grammar(rules)
        for batch in batches:
            found: Counter[str] = Counter()
            for s in batch.column("sequence").to_pylist():
                s = grammar.compressed(s)
                found.update(a + b for a, b in zip(s, s[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "c"])

    return run


def grammar_rules(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[str]:
    """The pairs that are replaced, in order: in each round the most frequent ones among ``sequences`` (sequence), of symbols of their own.

    Pairs of all sequences are counted; ``rounds * pairs`` rules at most come to the driver.
    """
    rules: list[str] = []
    for _ in range(rounds):
        counted = sequences.mapInArrow(_pairs(rules), "pair string, c bigint").groupBy("pair").agg(F.sum("c").alias("c"))
        firsts, seconds = set(), set()
        for pair, _c in counted.filter("c > 1").orderBy(F.desc("c"), "pair").limit(pairs).collect():
            if pair[0] not in seconds and pair[1] not in firsts:
                rules.append(pair)
                firsts.add(pair[0])
                seconds.add(pair[1])
        if not firsts:
            break
    return rules


_SOLVED = "sequence string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _solved(rules: list[str]):
    def run(batches):
        grammar = Grammar(rules)
        for batch in batches:
            rows = []
            for s in batch.column("sequence").to_pylist():
                initials = [_of(c)[0] for c in s]
                faults = Counter(_of(c)[1] for c in s)
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
                rows.append((s, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, *grammar.repaired(s)))
            names = [c.split()[0] for c in _SOLVED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if n in ("sequence", "audit") else pa.int64()) for n, v in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return run


_EDITS = "ord bigint, before string, edit string, new_role string, after string"


def _edits(batches):
    names = [c.split()[0] for c in _EDITS.split(", ")]
    made: list[tuple] = []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if n == "ord" else pa.string()) for n, v in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    for batch in batches:
        for pieces, sequence, audit in zip(batch.column("pieces"), batch.column("sequence"), batch.column("audit"), strict=True):
            places = (p["start"] + i for p in pieces.as_py() for i in range(p["n"]))
            last = None
            for before, edit, role in replay(sequence.as_py(), audit.as_py()):
                if last is not None:
                    made.append((*last, "" if edit else before))
                    if len(made) >= BATCH:
                        yield batch_of(made)
                        made = []
                last = (next(places), before, edit, role) if edit else None
    if made:
        yield batch_of(made)


class Repaired(NamedTuple):
    """turns: conv, conv_id, ord (the place of the turn by which a repaired one stands), part (its place among those), edit, role, text,
    in the order of conv, ord, part. conversations: conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""

    turns: DataFrame
    conversations: DataFrame


def _space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def conversation_key(conv_id: str = "conv_id") -> Column:
    """A text for each conv_id, null among them."""
    return F.concat(F.when(F.col(conv_id).isNull(), "n").otherwise("v"), F.coalesce(F.col(conv_id).cast("string"), F.lit("")))


def repair(rows: DataFrame) -> Repaired:
    """The cheapest repair of every conversation in ``rows`` (conv_id, turn, role, text).

    Turns are taken by turn, nulls first, then by role and by digest of the text. A turn's first fault counts: blank (no word),
    duplicate (role and text seen earlier in the conversation), truncated (the last character that is not white space is none of ``.!?``).

    A null role or text counts as one space; a null conv_id is a conversation of its own; rows that repeat are duplicates;
    gaps between turns ignore null turns; an empty table gives empty tables; other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    kept = rows.select(conversation_key().alias("conv"), "conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"))
    marked = saved(kept.withColumns({"digest": F.unhex(F.sha2("text", 256)), "id": F.monotonically_increasing_id()}), "turns")

    # Only what stands several times is looked up. Equal turns of one conversation are counted where they lie first.
    again = marked.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "id")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    looked_up = marked.join(again.select("conv", "role", "digest", F.col("first.id").alias("first_id")), ["conv", "role", "digest"], "left")
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("first_id") != F.col("id"), DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    kind = F.array_position(F.array(*map(F.lit, INITIALS)), F.substring("role", 1, 1))
    code = F.when(kind > 0, (kind - 1) * FAULTS).otherwise(len(INITIALS) * FAULTS) + fault + FIRST_SYMBOL
    order = ["conv", "turn", "role", "digest", "id"]
    classed = looked_up.select(*order, "conv_id", "text", F.char(code).alias("symbol"))
    ordered = saved(classed.repartitionByRange(*order).sortWithinPartitions(*order).drop("id", "digest").withColumns({"ord": F.monotonically_increasing_id(), "piece": F.spark_partition_id()}), "ordered")

    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "symbol"))), lambda x: x["symbol"]), "")
    pieces = ordered.groupBy("conv", "piece").agg(F.first("conv_id").alias("conv_id"), F.min("ord").alias("start"), F.count("*").alias("n"), in_order.alias("symbols"))
    along = F.array_sort(F.collect_list(F.struct("start", "n", "symbols")))
    whole = pieces.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), along.alias("p"))
    whole = saved(whole.select("conv", "conv_id", F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"))).alias("pieces"), F.array_join(F.col("p.symbols"), "").alias("sequence")), "sequences")

    distinct = saved(whole.select("sequence").distinct(), "distinct")
    solved = saved(distinct.mapInArrow(_solved(grammar_rules(distinct)), _SOLVED), "solved")
    size = solved.agg(F.sum(F.length("sequence") + F.length("audit") + 100)).first()[0] or 0
    known = saved(whole.join(F.broadcast(solved) if size <= BROADCAST_BYTES else solved, "sequence"), "known")

    edits = known.select("pieces", "sequence", "audit").mapInArrow(_edits, _EDITS)
    made = lambda roles: F.transform(F.filter(F.split(roles, ""), lambda r: r != ""), lambda r: F.struct(F.lit("I").alias("edit"), F.when(r == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("new_role") == "u", ROLES["u"]).when(F.col("new_role") == "a", ROLES["a"]).otherwise(F.col("role"))
    own = F.when(F.col("edit") == "D", F.array().cast("array<struct<edit:string,role:string,text:string>>")).otherwise(F.array(F.struct("edit", role.alias("role"), "text")))
    turns = (
        ordered.select("conv", "conv_id", "ord", "role", "text")
        .join(edits, "ord")
        .select("conv", "conv_id", "ord", F.posexplode(F.concat(made("before"), own, made("after"))).alias("part", "t"))
        .select("conv", "conv_id", "ord", "part", "t.edit", "t.role", "t.text")
    )
    places = marked.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.countDistinct("turn").alias("turns"))
    gaps = places.select("conv", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long").alias("gaps"))
    return Repaired(turns, known.join(gaps, "conv").select("conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


def _hashes(batches):
    import hashlib

    conv, digest = None, None
    for batch in batches:
        done = []
        for key, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if key != conv:
                if conv is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = key, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*done, strict=True)], names=["conv", "sha256"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha256"])


def transcript_hashes(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of each conversation in ``turns``, joined by line breaks.

    A hash runs along its lines, so a conversation's are streamed, sorted, through one task; none is put together.
    """
    lines = turns.select("conv", "ord", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "ord", "part").select("conv", "line").mapInArrow(_hashes, "conv string, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``rows`` with faults that follow from the CRC-32 of conversation and turn; nulls count as one space."""
    place = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn"))) % 20
    text = F.when(place == 1, "").when(place == 2, F.translate(_space("text"), ".!?", "")).otherwise(_space("text"))
    role = F.when(place == 4, "user").otherwise(_space("role"))
    times_ = F.when(place == 3, 2).otherwise(1)
    return rows.filter(place != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times_)).alias("_copy")).drop("_copy")
