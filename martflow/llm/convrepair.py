"""Conversation structure repair (operator 11).

A conversation's rows are damaged by a rule (see the contract of the query),
then repaired at least cost so that the initials of its roles read
``(s?(ua)+)?``: Keep 0, Rerole to the role that fits 1, Delete 2 (forced for blank and
duplicate rows), Insert an empty turn 5; an undeleted truncated row adds 5. Among cheapest
repairs the one whose audit (the edits' initials in order) is ASCII-least wins.

Cost DP. States: nothing yet, after s, after u, after a. Rows are range-partitioned by
(conversation, turn, ...), so a conversation of any size is cut into pieces, one per range
partition. A piece's 4 x 4 least costs between states come from a lock-step pass over all pieces
of a batch; a fold over the pieces of a conversation gives each piece the costs to go at its end.

Prefix-doubling path ranking. Nodes are (row, state) with the optimal arcs, which spend
exactly their cost of the cost to go. Round k ranks every node by the first 2**k
labels of its least audit, as the pair (its rank, rank of the node 2**k labels on), and doubles
the pointers. A node has at most one arc of a label, since the state fixes the role that Rerole and Insert give,
so ranks of one label choose the arc; doubled pointers then name the node after any number
of labels at once. Pieces report the audit and exit state for each entry state; a fold chains them.

Rows meet their audit in one stream a conversation to hash the repaired text: SHA-256 can only be
computed in order, so the time (not the memory) of this step follows the longest conversation.

Defined cases: null role and text are one space, in the rule's crc32 also conv_id and turn; a null
conv_id is a conversation of its own; rows of equal turn go by role, then by the MD5 of role and text, and repeated
rows count as often as they occur (the later ones as duplicates); a role without an initial, or with another than s,
u and a, can only be reroled or deleted; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martflow.llm.common import ranges, read_table, staged_map, stage

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5      # costs
FAR = 1 << 50                                                 # no way
CLEAN, DROP, CUT = 0, 1, 2                                    # what a row's first fault means for its edits
LABELS = np.frombuffer(b"DIKR", np.uint8)
#: state after a role's initial (s, u, a, other) from each state; -1: not allowed
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: state after a role chosen to fit (Rerole, Insert)
FITTING = np.array([2, 2, 3, 2])
ROLE_OF = {2: "user", 3: "assistant"}
#: costs to go and audits behind the last row: nothing and "after a" may end
TAIL, TAIL_AUDIT = [0, 2 * INSERT, INSERT, 0], ["", "II", "I", ""]


# ------------------------------------------------------------------ damage and faults
def damaged(rows: DataFrame) -> DataFrame:
    """ck (non-null key), turn, role, text after damage."""
    of = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                  F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    kind = F.col("kind")
    return (rows.select(_key().alias("ck"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        (F.crc32(of) % 20).alias("kind"))
            .where(kind != 0)
            .select("ck", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _key() -> Column:
    return F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))


def laid_out(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Damaged rows in order: rid grows with (ck, turn, role, digest). Rows that
    agree in all of these are alike, so any order of them will do."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    order = ["ck", "turn", "role", "digest"]
    return stage(spark, damaged(rows).withColumn("digest", digest).withColumn("tie", F.monotonically_increasing_id())
                 .repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
                 .withColumn("rid", F.monotonically_increasing_id()), "repair-rows")


def faults(laid: DataFrame) -> DataFrame:
    """rid, ck, initial (0 s, 1 u, 2 a, 3 other), blank, duplicate, truncated: a row's first fault."""
    first = laid.groupBy("ck", "digest").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    start = F.substring("role", 1, 1)
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    blank, again = body == "", F.col("first").isNull()
    return (laid.select("rid", "ck", F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3).alias("initial"),
                        blank.alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
            .join(first, "rid", "left")
            .select("rid", "ck", "initial", "blank", (~F.col("blank") & again).alias("duplicate"),
                    (~F.col("blank") & ~again & F.col("cut")).alias("truncated")))


# ------------------------------------------------------------------ cost DP
def _step_costs() -> np.ndarray:
    """Least cost from state to state over one row, inserts before it included, by initial * 3 + fault."""
    into = np.full((4, 4), FAR)
    for s in range(4):
        into[s, s] = 0
        into[s, FITTING[s]] = min(into[s, FITTING[s]], INSERT)
        twice = FITTING[FITTING[s]]
        into[s, twice] = min(into[s, twice], 2 * INSERT)
    out = np.full((12, 4, 4), FAR)
    for initial in range(4):
        for fault in (CLEAN, DROP, CUT):
            row = np.full((4, 4), FAR)
            for s in range(4):
                row[s, s] = DELETE
                extra = TRUNCATED if fault == CUT else 0
                if fault != DROP:
                    row[s, FITTING[s]] = min(row[s, FITTING[s]], REROLE + extra)
                    if AFTER[s, initial] >= 0:
                        row[s, AFTER[s, initial]] = min(row[s, AFTER[s, initial]], KEEP + extra)
            out[initial * 3 + fault] = (into[:, :, None] + row[None]).min(axis=1)
    return out


STEP = np.minimum(_step_costs(), FAR)


def costs_to_go(code: np.ndarray, ptr: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go of every (row, state) and of every piece's end: piece p has rows
    ptr[p] + p .. ptr[p + 1] + p, the last of which is its end with ``end[p]``."""
    size = np.diff(ptr)
    togo = np.empty((len(code) + len(size), 4), np.int64)
    last = ptr[1:] + np.arange(len(size))
    togo[last] = end
    by = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[by], -np.arange(1, size.max(initial=0) + 1), "right")
    for back, n in enumerate(active, 1):                # all pieces at once, from their ends
        p = by[:n]
        at = last[p] - back
        togo[at] = np.minimum((STEP[code[ptr[p + 1] - back]] + togo[at + 1][:, None, :]).min(axis=2), FAR)
    return togo


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    code = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return code, np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths(), np.int64))))


def _piece_costs(batches):
    """Add costs[s * 4 + e]: least cost through the piece from state s to e."""
    for b in batches:
        code, ptr = _codes(b.column("codes"))
        first = ptr[:-1] + np.arange(b.num_rows)
        ways = np.empty((b.num_rows, 4, 4), np.int64)
        for e in range(4):
            end = np.full((b.num_rows, 4), FAR)
            end[:, e] = 0
            ways[:, :, e] = costs_to_go(code, ptr, end)[first]
        flat = pa.FixedSizeListArray.from_arrays(pa.array(ways.ravel()), 16).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns, flat], names=[*b.schema.names, "costs"])


# ------------------------------------------------------------------ path ranking
def optimal_arcs(code: np.ndarray, ptr: np.ndarray, togo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node (row * 4 + state; ends of pieces are nodes too) and label D, I, K, R
    the node that an optimal arc leads to, else -1."""
    nodes = len(togo) * 4
    target = np.full((nodes, 4), -1, np.int64)
    row = np.arange(len(code)) + np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    initial, fault = code // 3, code % 3
    extra = np.where(fault == CUT, TRUNCATED, 0)
    for s in range(4):
        here, node = togo[row, s], row * 4 + s
        real = here < FAR

        def arc(label, to_row, to_state, cost, allowed):
            ok = real & allowed & (togo[to_row, np.maximum(to_state, 0)] + cost == here)
            target[node[ok], label] = (to_row * 4 + to_state)[ok]

        every = np.ones(len(row), bool)
        arc(0, row + 1, np.full(len(row), s), DELETE, every)
        arc(1, row, np.full(len(row), FITTING[s]), INSERT, every)
        arc(2, row + 1, AFTER[s, initial], KEEP + extra, (fault != DROP) & (AFTER[s, initial] >= 0))
        arc(3, row + 1, np.full(len(row), FITTING[s]), REROLE + extra, fault != DROP)
    return target, np.flatnonzero((target >= 0).any(axis=1))


def rank_paths(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Per node the label of its least audit's first edit, the rank of that audit among
    all nodes' audits, pointers by powers of two, and the audit's length."""
    nodes = np.arange(len(target))
    has = (target >= 0).any(axis=1)
    # Ranks of one label: 0 for a path's end, so a shorter audit goes before its continuations.
    label = np.where(has, (target >= 0).argmax(axis=1), -1)
    rank = label + 1
    pointer = np.where(has, target[nodes, np.maximum(label, 0)], nodes)
    length = has.astype(np.int64)
    pointers = []
    while True:
        pointers.append(pointer)
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer] * (length > 0), return_inverse=True)
        further = length[pointer] * (length > 0)
        if not further.any():
            return label, rank, pointers, length
        length = length + further
        pointer = pointer[pointer]


def audits(start: np.ndarray, label: np.ndarray, pointers: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the least audits from ``start`` nodes, their offsets and last nodes."""
    size = length[start]
    node = np.repeat(start, size)
    step = ranges(np.zeros(len(start), np.int64), size)
    end = start.copy()
    for k, pointer in enumerate(pointers):
        node = np.where(step >> k & 1, pointer[node], node)
        end = np.where(size >> k & 1, pointer[end], end)
    return LABELS[label[node]], np.concatenate(([0], np.cumsum(size))), end


def _piece_audits(batches):
    """ck, pid, first, last, inside (illegal pairs), costs; audits and exits by entry state."""
    for b in batches:
        code, ptr = _codes(b.column("codes"))
        end = b.column("end").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4)
        togo = costs_to_go(code, ptr, end)
        label, _, pointers, length = rank_paths(optimal_arcs(code, ptr, togo)[0])
        first = ptr[:-1] + np.arange(b.num_rows)
        start = (first[:, None] * 4 + np.arange(4)).ravel()
        text, cut, exits = audits(start, label, pointers, length)
        texts = pa.StringArray.from_buffers(len(start), pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(text.tobytes()))
        four = pa.array(np.arange(0, len(start) + 1, 4, dtype=np.int32))
        initial = code // 3
        bad = ~legal(initial[:-1], initial[1:]) if len(code) else np.zeros(0, bool)
        bad = np.concatenate(([0], np.cumsum(bad), [0]))
        inside = bad[ptr[1:] - 1] - bad[ptr[:-1]]
        yield pa.RecordBatch.from_arrays(
            [b.column("ck"), b.column("pid"), pa.array(initial[ptr[:-1]]), pa.array(initial[ptr[1:] - 1]),
             pa.array(inside.astype(np.int64)), pa.ListArray.from_arrays(four, pa.array(togo[first].ravel())),
             pa.ListArray.from_arrays(four, texts), pa.ListArray.from_arrays(four, pa.array(exits % 4))],
            names=["ck", "pid", "first", "last", "inside", "togo", "audits", "exits"])


def legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def _legal(a: Column, b: Column) -> Column:
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def repaired(spark: SparkSession, flagged: DataFrame) -> DataFrame:
    """ck, cost, illegal, audit of every conversation that has rows."""
    fault = F.when(F.col("blank") | F.col("duplicate"), DROP).when(F.col("truncated"), CUT).otherwise(CLEAN)
    pair = F.struct("rid", (F.col("initial") * 3 + fault).cast("tinyint").alias("code"))
    # A piece is what one range partition holds of a conversation.
    pieces = (flagged.groupBy("ck", F.shiftright("rid", 33).alias("pid"))
              .agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["code"]).alias("codes")))
    kinds = "ck string, pid long, codes array<tinyint>"
    pieces = staged_map(spark, pieces, _piece_costs, f"{kinds}, costs array<long>", 1000, "repair-pieces")
    # Costs to go at the end of each piece: a fold from the last piece of a conversation to its first.
    some = F.array_sort(F.collect_list(F.struct("pid", "costs")))

    def before(acc, piece):
        togo = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.zip_with(
            F.slice(piece["costs"], s * 4 + 1, 4), acc["togo"], lambda a, c: F.least(a + c, F.lit(FAR)))))
        return F.struct(togo.alias("togo"), F.concat(acc["ends"], F.array(F.struct(
            piece["pid"].alias("pid"), acc["togo"].alias("end")))).alias("ends"))

    tail = F.array(*[F.lit(x).cast("long") for x in TAIL])
    start = F.struct(tail.alias("togo"), F.array().cast("array<struct<pid:bigint,end:array<bigint>>>").alias("ends"))
    ends = (pieces.groupBy("ck").agg(F.reverse(some).alias("all"))
            .select("ck", F.explode(F.aggregate("all", start, before)["ends"]).alias("e")).select("ck", "e.pid", "e.end"))
    found = staged_map(spark, pieces.drop("costs").join(ends, ["ck", "pid"]), _piece_audits,
                       "ck string, pid long, first long, last long, inside long, togo array<long>, "
                       "audits array<string>, exits array<long>", 1000, "repair-audits")

    def after(acc, piece):
        return F.struct(F.element_at(piece["exits"], (acc["state"] + 1).cast("int")).alias("state"),
                        F.concat(acc["parts"], F.array(F.element_at(piece["audits"], (acc["state"] + 1).cast("int")))).alias("parts"),
                        piece["last"].alias("last"),
                        (acc["illegal"] + piece["inside"]
                         + F.when((acc["last"] >= 0) & ~_legal(acc["last"], piece["first"]), 1).otherwise(0)).alias("illegal"))

    zero = F.struct(F.lit(0).cast("long").alias("state"), F.array().cast("array<string>").alias("parts"),
                    F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("illegal"))
    tails = F.array(*[F.lit(x) for x in TAIL_AUDIT])
    chain = F.col("chain")
    return (found.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct(
                "pid", "first", "last", "inside", "togo", "audits", "exits"))).alias("all"))
            .select("ck", F.col("all")[0]["togo"][0].alias("cost"), F.aggregate("all", zero, after).alias("chain"))
            .select("ck", "cost", chain["illegal"].alias("illegal"),
                    F.concat(F.array_join(chain["parts"], ""),
                             F.element_at(tails, (chain["state"] + 1).cast("int"))).alias("audit")))


# ------------------------------------------------------------------ repaired text
def _hashes(batches):
    """Rows of a conversation come in order behind its audit (rid -1)."""
    held = None

    def apply(stop_at_row: bool):
        """Inserted turns up to the next edit that takes a row (or the audit's end)."""
        while held["at"] < len(held["audit"]):
            op = held["audit"][held["at"]]
            if op != "I" and stop_at_row:
                held["at"] += 1
                return op
            held["at"] += 1
            held["state"] = int(FITTING[held["state"]])
            add(ROLE_OF[held["state"]], "")
        return None

    def add(role: str, text: str):
        line = f"{role}:{text}"
        held["sha"].update((f"\n{line}" if held["lines"] else line).encode())
        held["lines"] += 1

    def row(role: str, text: str):
        op = apply(True)
        if op == "K":
            held["state"] = int(AFTER[held["state"], "sua".index(role[0])])
            add(role, text)
        elif op == "R":
            held["state"] = int(FITTING[held["state"]])
            add(ROLE_OF[held["state"]], text)

    def done():
        apply(False)
        return held["ck"], held["sha"].hexdigest()

    for b in batches:
        out = []
        for r in zip(*(b.column(c).to_pylist() for c in ("ck", "rid", "role", "text"))):
            if r[1] < 0:
                if held:
                    out.append(done())
                held = {"ck": r[0], "audit": r[3], "at": 0, "state": 0, "sha": hashlib.sha256(), "lines": 0}
            else:
                row(r[2], r[3])
        yield pa.RecordBatch.from_pylist([{"ck": k, "sha": v} for k, v in out], pa.schema([("ck", pa.string()), ("sha", pa.string())]))
    if held:
        k, v = done()
        yield pa.RecordBatch.from_pylist([{"ck": k, "sha": v}], pa.schema([("ck", pa.string()), ("sha", pa.string())]))


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row per conversation, as the contract of the query lists them."""
    laid = laid_out(spark, rows)
    flagged = stage(spark, faults(laid), "repair-faults")
    fixed = stage(spark, repaired(spark, flagged), "repair-fixed")
    heads = fixed.select("ck", F.lit(-1).cast("long").alias("rid"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = (laid.select("ck", "rid", "role", "text").unionByName(heads).repartition("ck").sortWithinPartitions("ck", "rid"))
    hashes = staged_map(spark, stream, _hashes, "ck string, sha string", 1000, "repair-hashes")
    counts = flagged.groupBy("ck").agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    turns = laid.groupBy("ck").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (rows.select("conv_id", _key().alias("ck")).distinct()
            .join(turns, "ck", "left").join(counts, "ck", "left").join(fixed, "ck", "left").join(hashes, "ck", "left")
            .select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return repair(spark, read_table(spark, sf_dir, "conversations"))
