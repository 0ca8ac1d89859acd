"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily: an acceptor of a conversation's rows, a transducer of the edits Keep, Rerole, Delete and
Insert with their costs, and an acceptor of the role grammar ``(s?(ua)+)?`` over role initials. Weights are pairs (cost, edit
labels), added component by component and compared in that order, so the shortest path is the cheapest repair and, among
equals, the one whose labels come first. Inserts stand before the row they precede; a path that meets a grammar state twice
at one place is never cheapest, so the composed machine is followed in topological order: by row, then by inserts made.

Long conversations are cut into stretches of at most 2 ** ``STRETCH_BITS`` = 1,024 rows. A stretch is one matrix of weights between grammar
states, made in its own task. Matrices of a conversation are folded twice, costs only: from the end for what each state still
costs, then from the start for the state in which each stretch begins. Two label strings of one stretch read the same
rows and end with a row's label, so neither begins the other and their order decides that of the whole strings; the
fold needs only the rank of a matrix's strings. So no task holds the rows of a conversation: it holds (rows / 1,024) small matrices.

Order: conversations are dealt by ranges of (conv_id, turn, role, text's beginning, its digest, place in the input) and sorted, so
that a conversation with a third of all rows lies in many tasks, also if its rows are all alike. Only the
SHA-256 of a conversation of several stretches, which can't be divided, runs over its repaired texts in one task, chunk by
chunk in constant memory.

Defined results: a null role or text is one space, as are null ids in the damage key; null conv_ids are one conversation. Rows
of one turn come by role, then by the first 64 characters of the text, then by its digest; equal rows are
duplicates but for the first. An empty role has no initial and is legal nowhere. A conversation that lost all its rows has zeros. An
empty table gives an empty result; other columns don't enter. A long text is never cut. ``gaps`` beyond a long is null.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import Scratch, map_texts, read_table

#: Rows of a conversation that one matrix stands for at most (by binary digits of the row number).
STRETCH_BITS = 10
#: Role grammar: from state (0 at the start, 1 after s, 2 after u, 3 after a) by a role's initial to a state; 0 and 3 accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
#: One letter stands for a row: its initial (o: any other), a capital if it is truncated, a digit if it must be deleted.
INITIALS, CUT, GONE = "suao", "SUAO", "1234"
_INITIAL = str.maketrans(CUT + GONE, INITIALS * 2)
_WORD = r"[^\x20\x09-\x0D]"
#: A cost that no path reaches.
NONE = 1 << 60


# --- the three machines, and paths through their composition ---------------------------------------


def edits(row: str):
    """Arcs of the edit transducer over a row: (label, initial that comes out or "", cost)."""
    if row not in GONE:
        more = TRUNCATED if row in CUT else 0
        yield "K", row.translate(_INITIAL), KEEP + more
        for initial in ROLES:
            yield "R", initial, REROLE + more
    yield "D", "", DELETE


def _relax(states: dict, state: int, weight: tuple) -> None:
    if state not in states or weight < states[state]:
        states[state] = weight


def shortest_paths(rows: str, start: int) -> dict:
    """Least weight (cost, labels) by grammar state after the rows, from one grammar state before them."""
    here = {start: (0, "")}
    for row in rows:
        after: dict = {}
        for _ in GRAMMAR:  # by inserts made before this row
            inserted: dict = {}
            for state, (cost, labels) in here.items():
                for label, initial, price in edits(row):
                    to = GRAMMAR[state].get(initial) if initial else state
                    if to is not None:
                        _relax(after, to, (cost + price, labels + label))
                for initial in ROLES:
                    if initial in GRAMMAR[state]:
                        _relax(inserted, GRAMMAR[state][initial], (cost + INSERT, labels + "I"))
            here = inserted
        here = after
    return here


def closing(state: int) -> int:
    """Inserts that lead from a grammar state to an accepting one."""
    n = 0
    while state not in ACCEPTING:
        state, n = next(GRAMMAR[state][initial] for initial in ROLES if initial in GRAMMAR[state]), n + 1
    return n


def matrix(rows: str) -> tuple[list[int], list[int], list[str]]:
    """Costs between grammar states, ranks of their labels among those from one state, and the labels; row by row."""
    costs, ranks, paths = [], [], []
    for start in range(len(GRAMMAR)):
        found = shortest_paths(rows, start)
        order = {labels: k for k, labels in enumerate(sorted(labels for _, labels in found.values()))}
        for end in range(len(GRAMMAR)):
            cost, labels = found.get(end, (NONE, ""))
            costs.append(cost)
            ranks.append(order.get(labels, 0))
            paths.append(labels)
    return costs, ranks, paths


@functools.lru_cache(100_000)
def _matrix_of_few(rows: str) -> tuple[list[int], list[int], list[str]]:
    return matrix(rows)


def fold(costs: np.ndarray, ranks: np.ndarray) -> tuple[list[int], list[int], int]:
    """Start and end state of each stretch on the shortest path through their matrices, and its cost."""
    k, n = len(costs), len(GRAMMAR)
    left = np.empty((k + 1, n), np.int64)
    left[k] = [INSERT * closing(state) for state in range(n)]
    for t in range(k - 1, -1, -1):
        left[t] = np.minimum((costs[t] + left[t + 1]).min(axis=1), NONE)
    state, starts, ends = 0, [], []
    for t in range(k):
        starts.append(state)
        through = costs[t, state] + left[t + 1]
        state = min(np.flatnonzero(through == through.min()).tolist(), key=lambda end: ranks[t, starts[-1], end])  # noqa: B023
        ends.append(state)
    return starts, ends, int(left[0, 0])


def apply_edits(labels: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The repaired rows that edit labels make of a stretch that begins in a grammar state."""
    out, at = [], 0
    for label in labels:
        if label == "D":
            at += 1
            continue
        role, text = (roles[at], texts[at]) if label != "I" else ("", "")
        initial = role[:1] if label == "K" else next(i for i in ROLES if i in GRAMMAR[state])
        out.append({"role": role if label == "K" else ROLES[initial], "text": text})
        state, at = GRAMMAR[state][initial], at + (label != "I")
    return out


# --- the tables ------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` deals: 0 drops a row, 1 empties its text,
    2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20).alias("deal"))
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("deal") == 3, 2).otherwise(1)))
    return rows.where("deal != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _in_order(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """A table of the rows with ``pos``, their place in the order, and ``stretch``; equal rows are told apart by where they are read."""
    keyed = rows.select("conv_id", "turn", "role", "text", F.substring("text", 1, 64).alias("begins"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.monotonically_increasing_id().alias("place"))
    order = ["conv_id", "turn", "role", "begins", "digest", "place"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    blank, cut = ~F.col("text").rlike(_WORD), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    placed = placed.select("conv_id", "turn", "role", "text", "digest", "pos", blank.alias("blank"), cut.alias("cut"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
    return scratch.write(placed.withColumn("stretch", F.shiftright("pos", STRETCH_BITS)), "conversation-rows")


def _stretches(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per stretch: fault counts, its letters and its matrix."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    seen = rows.select("conv_id", "stretch", "pos", "blank", "cut", "initial").join(first, "pos", "left")
    twice = ~F.col("blank") & F.col("first").isNull()
    faults = seen.select("conv_id", "stretch", "pos", "initial", "blank", twice.alias("twice"), (F.col("cut") & ~F.col("blank") & ~twice).alias("cut"))
    letter = F.when(F.col("blank") | F.col("twice"), F.translate("initial", INITIALS, GONE)).when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", letter.alias("letter")))), lambda s: s["letter"]), "")
    count = lambda c, name: F.count_if(c).alias(name)
    grouped = faults.groupBy("conv_id", "stretch").agg(count("blank", "blank"), count("twice", "duplicate"), count("cut", "truncated"), letters.alias("letters"))

    def run(table: pa.Table):
        rows_of = table.column("letters").to_pylist()
        found = [(_matrix_of_few if len(rows) <= 32 else matrix)(rows) for rows in rows_of]
        whole = [rows.translate(_INITIAL) for rows in rows_of]
        illegal = [sum(w[i : i + 2] not in LEGAL for i in range(len(w) - 1)) for w in whole]
        out = table.drop_columns(["letters"]).append_column("ends", pa.array([w[0] + w[-1] for w in whole], pa.string())).append_column("illegal", pa.array(illegal, pa.int64()))
        for k, (name, kind) in enumerate((("costs", pa.int64()), ("ranks", pa.int32()), ("paths", pa.string()))):
            out = out.append_column(name, pa.array([f[k] for f in found], pa.list_(kind)))
        yield from out.combine_chunks().to_batches()

    schema = grouped.drop("letters").schema.add("ends", "string").add("illegal", "long").add("costs", ArrayType(LongType())).add("ranks", ArrayType(IntegerType())).add("paths", ArrayType(StringType()))
    return scratch.write(map_texts(grouped, run, schema, 2000), "stretches")


def _runs(batches, key: str):
    """Rows of sorted batches, gathered while their key stays the same: (key, list of rows)."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != last:
                yield last, rows
                rows = []
            last = row[key]
            rows.append(row)
    if rows:
        yield last, rows


def _chosen(stretches: DataFrame) -> DataFrame:
    """Rows (conv_id, stretch, start, pick, closing, alone, cost, border): the matrix entry of each stretch on its conversation's shortest path."""
    n = len(GRAMMAR)

    def run(batches):
        out: list[dict] = []
        for conv, rows in _runs(batches, "conv_id"):
            shape = (len(rows), n, n)
            starts, ends, cost = fold(np.array([r["costs"] for r in rows], np.int64).reshape(shape), np.array([r["ranks"] for r in rows]).reshape(shape))
            for k, (row, a, b) in enumerate(zip(rows, starts, ends, strict=True)):
                last = k + 1 == len(rows)
                border = int(k > 0 and rows[k - 1]["ends"][1] + row["ends"][0] not in LEGAL)
                out.append({"conv_id": conv, "stretch": row["stretch"], "start": a, "pick": n * a + b, "closing": closing(b) if last else 0, "alone": len(rows) == 1, "cost": 0 if k else cost, "border": border})
                if len(out) >= 4000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    kind = stretches.schema["conv_id"].dataType.simpleString()
    narrow = stretches.select("conv_id", "stretch", "costs", "ranks", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    ddl = f"conv_id {kind}, stretch long, start int, pick int, closing int, alone boolean, cost long, border long"
    schema = pa.schema([("conv_id", to_arrow_type(stretches.schema["conv_id"].dataType)), ("stretch", pa.int64()), ("start", pa.int32()), ("pick", pa.int32()), ("closing", pa.int32()), ("alone", pa.bool_()), ("cost", pa.int64()), ("border", pa.int64())])
    return narrow.mapInArrow(run, ddl)


def repair(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Cheapest repair of conversations (conv_id, turn, role, text): their ordered rows, and one row per stretch.

    A stretch has fault counts, ``edits`` (its part of the audit), ``alone`` (it is all of its conversation), and ``repaired``, its
    repaired rows as array<struct<role, text>>. Both are tables of ``scratch``.
    """
    ordered = _in_order(rows, scratch)
    stretches = _stretches(ordered, scratch)
    same = lambda left, right: [left["conv_id"].eqNullSafe(right["conv_id"]), left["stretch"] == right["stretch"]]
    chosen = _chosen(stretches)
    plan = stretches.join(chosen, same(stretches, chosen)).select(
        stretches["conv_id"], stretches["stretch"], "blank", "duplicate", "truncated", (F.col("illegal") + F.col("border")).alias("illegal"), "cost", "alone", "start",
        F.concat(F.element_at("paths", F.col("pick") + 1), F.repeat(F.lit("I"), F.col("closing"))).alias("edits"),
    )
    texts = ordered.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    both = plan.join(texts, same(plan, texts)).select(*(plan[c] for c in plan.columns), F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))

    def run(table: pa.Table):
        columns = (table.column(c).to_pylist() for c in ("edits", "start", "roles", "texts"))
        made = [apply_edits(*x) for x in zip(*columns, strict=True)]
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        yield from table.drop_columns(["start", "roles", "texts"]).append_column("repaired", pa.array(made, kind)).combine_chunks().to_batches()

    schema = plan.drop("start").schema.add("repaired", ArrayType(StructType().add("role", "string").add("text", "string")))
    return ordered, scratch.keep(map_texts(both, run, schema, 200), "repaired")


def _lines() -> Column:
    return F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))


def text_digests(repaired: DataFrame) -> DataFrame:
    """Rows (conv_id, digest): SHA-256 of the repaired ``role:text`` lines of conversations of several stretches, one after the other."""
    def run(batches):
        state, last, some, out = None, None, False, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != last:
                    if state is not None:
                        out.append((last, state.hexdigest()))
                    state, last, some = hashlib.sha256(), row["conv_id"], False
                if row["some"]:
                    state.update((b"\n" if some else b"") + row["chunk"].encode("utf-8", "surrogatepass"))
                    some = True
            if len(out) >= 4000:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([d for _, d in out], pa.string())], ["conv_id", "digest"])
                out = []
        if state is not None:
            out.append((last, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([d for _, d in out], pa.string())], ["conv_id", "digest"])

    kind = to_arrow_type(repaired.schema["conv_id"].dataType)
    parts = repaired.where("not alone").select("conv_id", "stretch", (F.size("repaired") > 0).alias("some"), F.array_join(_lines(), "\n").alias("chunk"))
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, digest string")


def audit_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the damaged rows' repair: gaps, fault counts, cost, audit and digest."""
    with Scratch(conversations.sparkSession) as own:
        ordered, repaired = repair(damage(conversations), own)
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        turns = ordered.groupBy("conv_id").agg((F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count_distinct("turn")).alias("gaps"))
        parts = F.sort_array(F.collect_list(F.struct("stretch", "edits")))
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        one = F.when(F.col("alone"), F.sha2(F.array_join(_lines(), "\n"), 256))
        found = repaired.groupBy("conv_id").agg(*sums, F.array_join(F.transform(parts, lambda s: s["edits"]), "").alias("audit"), F.max(one).alias("one"))
        digests = text_digests(repaired)
        every = conversations.select("conv_id").distinct()
        out = every
        for k, side in enumerate((turns, found, digests)):
            side = side.withColumnRenamed("conv_id", f"conv{k}")
            out = out.join(side, F.col("conv_id").eqNullSafe(F.col(f"conv{k}")), "left")
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        gaps = F.when(F.col("gaps").isNull(), F.lit(0).cast("long")).otherwise(F.expr("try_cast(gaps as bigint)"))
        out = out.select("conv_id", gaps.alias("gaps"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", "one", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
        return own.keep(out, "audited")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation after the dealt damage."""
    return audit_conversations(read_table(spark, sf_dir, "conversations"))
