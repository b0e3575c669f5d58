"""Repair of conversation structure by a rank-convergence parallel Viterbi.

Roles of a repaired conversation read ``(s?(ua)+)?`` by their initials, an automaton of four states. The cost to finish from each
state is a vector; walking backwards over the rows turns it into the vector before. Rows are dealt into segments that
never hold more than ``chunk`` rows, so a long conversation is many segments in many tasks. All start at once, all but the last one
from a speculative vector of zeros. Fix-up passes give a segment what its successor found and run it again, row by row, until
old and new vectors differ by a constant only: from there on the old ones hold. When no segment has anything new to
tell, the constants add up to the cost, and the stitched vectors drive a forward trace that takes the least
letter among cheapest edits. In every state each letter leads to one state, so the trace of a segment is a map of states,
and the maps are composed by doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallytree.llm.rawtext import WORD_PATTERN
from tallytree.session import pin

CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. What each initial leads to, where it may stand.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
#: The role that a state asks for, and the state that it leads to.
WANTED = {q: ("a", AFTER_A) if q == AFTER_U else ("u", AFTER_U) for q in range(4)}
ROLES = {"u": "user", "a": "assistant"}
#: Cost to finish after the last row: a lone s needs two insertions, an open question one.
END = (0, 2 * INSERT, INSERT, 0)
_BIG = 1 << 60


def _options(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row.

    A row is one number: 0 if it has to go, else 1 and the place of its initial in `` sua``, and 4 more if it is truncated.
    """
    out = [("D", DELETE, state)]
    if code:
        initial, extra = " sua"[(code - 1) % 4], TRUNCATED * (code > 4)
        to = NEXT.get(initial, {}).get(state)
        if to is not None:
            out.append(("K", KEEP + extra, to))
        out.append(("R", REROLE + extra, WANTED[state][1]))
    return out


class Steps:
    """Backward steps and their traces, remembered: only few vectors occur once their least value is taken off."""

    def __init__(self):
        self._back: dict = {}
        self._letters: dict = {}

    def back(self, vector: tuple, code: int) -> tuple[tuple, int]:
        """The vector before a row, less its least value, and that value."""
        got = self._back.get((vector, code))
        if got is None:
            costs = [min(c + vector[to] for _, c, to in _options(code, q)) for q in range(4)]
            for _ in range(3):  # insertions before the row; three lead through all states
                costs = [min(costs[q], INSERT + costs[WANTED[q][1]]) for q in range(4)]
            least = min(costs)
            got = self._back[vector, code] = tuple(c - least for c in costs), least
        return got

    def letters(self, vector: tuple, code: int, state: int) -> tuple[str, int]:
        """The least letters of the cheapest edits of a row, insertions before it included, and the state after it."""
        got = self._letters.get((vector, code, state))
        if got is None:
            before, least = self.back(vector, code)
            text, q = "", state
            while not text or text[-1] == "I":
                left = before[q] + least
                choices = [(x, to) for x, c, to in _options(code, q) if c + vector[to] == left]
                if INSERT + before[WANTED[q][1]] + least == left:
                    choices.append(("I", WANTED[q][1]))
                letter, q = min(choices)
                text += letter
            got = self._letters[vector, code, state] = text, q
        return got

    def run(self, codes: bytes, right: tuple) -> list[tuple[tuple, int]]:
        """The vectors at all boundaries from the right, each with the constant taken off since the right end."""
        out, total = [(right, 0)], 0
        for code in reversed(codes):
            right, least = self.back(right, code)
            total += least
            out.append((right, total))
        return out

    def fix_up(self, codes: bytes, old: list[tuple[tuple, int]], right: tuple) -> tuple[list[tuple[tuple, int]], int]:
        """``run`` for another right end, until vectors agree but for a constant; and the number of rows that were run again."""
        out, total = [(right, 0)], 0
        for k, code in enumerate(reversed(codes)):
            if right == old[k][0]:
                shift = total - old[k][1]
                return out + [(v, c + shift) for v, c in old[k + 1 :]], k
            right, least = self.back(right, code)
            total += least
            out.append((right, total))
        return out, len(codes)

    def trace(self, codes: bytes, vectors: list[tuple[tuple, int]], state: int) -> tuple[str, int]:
        """The letters of a segment that is entered in ``state``, and the state that it leaves."""
        text = []
        for k, code in enumerate(codes):
            letters, state = self.letters(vectors[len(codes) - k - 1][0], code, state)
            text.append(letters)
        return "".join(text), state


def _map_rows(df: DataFrame, schema: str, make):
    """mapInArrow over rows as dicts; ``make`` is called once per task and gives the function of a row."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in stream:
            rows = [each(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kinds[c.split()[1]]) for i, c in enumerate(schema.split(", "))], names)

    return df.mapInArrow(work, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as the damage leaves them; its kind follows from crc32 of ``conv_id:turn``. Nulls of role and text, and in that key, are one space."""
    plain = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return rows.filter(kind != 0).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation, turn, role and text, each with its place; texts of one turn are ordered by digest.

    Ordering is by ranges, so that a long conversation spreads over tasks.
    """
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    keyed = rows.withColumn("key", F.concat(F.substring("role", 1, 1), key))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("key")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())


def segments(placed: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, segment, codes, number of rows that are blank, duplicate, truncated), in order of ``segment``.

    ``placed`` has conv_id, pos, key, initial, is_blank, is_open. A row is a duplicate if an earlier one has its key.
    """
    firsts = placed.filter("NOT is_blank").groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = placed["conv_id"].eqNullSafe(F.col("_conv")) & (placed["key"] == F.col("_key"))
    seen = placed.join(firsts, same, "left").withColumn("is_dup", ~F.col("is_blank") & (F.coalesce("first", "pos") < F.col("pos")))
    forced = F.col("is_blank") | F.col("is_dup")
    open_end = ~forced & F.col("is_open")
    initial = F.instr(F.lit("sua"), F.col("initial")) * (F.length("initial") == 1).cast("int")
    code = F.when(forced, 0).otherwise(1 + initial + 4 * F.col("is_open").cast("int"))
    # Places are the number of the partition above 33 bits and a count inside it.
    cut = F.shiftright("pos", 33) * (1 << 33) + F.floor(F.pmod("pos", F.lit(1 << 33)) / chunk)
    rows = seen.select(
        "conv_id", cut.alias("segment"), F.struct("pos", F.lpad(F.hex(code), 2, "0").alias("code")).alias("at"),
        F.col("is_blank").cast("long").alias("blank"), F.col("is_dup").cast("long").alias("duplicate"), open_end.cast("long").alias("truncated"))
    return rows.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list("at")).alias("rows"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated")).withColumn("codes", F.unhex(F.array_join(F.transform("rows", lambda r: r["code"]), ""))).drop("rows")


def solve(parts: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, segment, cost share, letters) of segments with conv_id, segment and codes, and the number of fix-up passes.

    Segments that only hold rows which have to go change no vector and stand aside.
    """
    active = F.length(F.regexp_replace(F.hex("codes"), "00", "")) > 0
    window = Window.partitionBy("conv_id").orderBy("segment")
    links = parts.filter(active).select("conv_id", "segment").withColumns({
        "ix": F.row_number().over(window), "following": F.lead("segment").over(window)})
    links = pin(links, "viterbi-links")
    keyed = links.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), "ix", "following")
    chain = parts.join(keyed, parts["conv_id"].eqNullSafe(F.col("_c")) & (parts["segment"] == F.col("_s"))).select(
        "conv_id", "segment", "ix", "following", "codes",
        F.when(F.col("following").isNull(), F.array(*map(F.lit, END))).otherwise(F.array(*[F.lit(0)] * 4)).alias("right"))

    def first_run():
        steps = Steps()

        def each(row):
            vectors = steps.run(row["codes"], tuple(row["right"]))
            return (*(row[c] for c in ("conv_id", "segment", "ix", "following", "codes")), row["right"], list(vectors[-1][0]), vectors[-1][1])
        return each

    kind = parts.schema["conv_id"].dataType.simpleString().replace("bigint", "long")
    schema = f"conv_id {kind}, segment long, ix int, following long, codes binary, right array<int>, left array<int>, off long"
    state = pin(_map_rows(chain, schema, first_run), "viterbi-run")
    most = state.agg(F.max("ix")).first()[0] or 1
    passes = 0
    while most > 1:
        told = state.select(F.col("conv_id").alias("_c"), (F.col("ix") - 1).alias("_ix"), F.col("left").alias("new"))
        met = state.join(told, state["conv_id"].eqNullSafe(F.col("_c")) & (state["ix"] == F.col("_ix")), "left").drop("_c", "_ix")
        met = met.withColumn("new", F.coalesce("new", "right"))
        if met.filter("new <> right").isEmpty():
            break

        def again():
            steps = Steps()

            def each(row):
                right, left, off = row["new"], row["left"], row["off"]
                if right != row["right"]:
                    vectors, _ = steps.fix_up(row["codes"], steps.run(row["codes"], tuple(row["right"])), tuple(right))
                    left, off = list(vectors[-1][0]), vectors[-1][1]
                return (*(row[c] for c in ("conv_id", "segment", "ix", "following", "codes")), right, left, off)
            return each

        state = pin(_map_rows(met, schema, again), "viterbi-fix-up")
        passes += 1

    def exits():
        steps = Steps()

        def each(row):
            vectors = steps.run(row["codes"], tuple(row["right"]))
            return row["conv_id"], row["segment"], row["ix"], [steps.trace(row["codes"], vectors, q)[1] for q in range(4)]
        return each

    # Where a segment leads from each state; composed with all segments before it, by doubling.
    entry = state.select("conv_id", "segment", "ix", F.lit(START).alias("state"))
    if most > 1:
        reach = pin(_map_rows(state.filter("following IS NOT NULL"), f"conv_id {kind}, segment long, ix int, leads array<int>", exits), "viterbi-leads")
        step = 1
        while step < most:
            earlier = reach.select(F.col("conv_id").alias("_c"), (F.col("ix") + step).alias("_ix"), F.col("leads").alias("before"))
            reach = pin(
                reach.join(earlier, reach["conv_id"].eqNullSafe(F.col("_c")) & (reach["ix"] == F.col("_ix")), "left").select(
                    "conv_id", "segment", "ix",
                    F.when(F.col("before").isNull(), F.col("leads")).otherwise(
                        F.expr("transform(before, q -> leads[q])")).alias("leads")), "viterbi-leads")
            step *= 2
        left = reach.select(F.col("conv_id").alias("_c"), (F.col("ix") + 1).alias("_ix"), F.col("leads")[START].alias("state"))
        entry = state.select("conv_id", "segment", "ix").join(
            left, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("ix") == F.col("_ix")), "left").select(
            "conv_id", "segment", "ix", F.coalesce("state", F.lit(START)).alias("state"))
    entry = entry.select(F.col("conv_id").alias("_c"), F.col("ix").alias("_ix"), "state")
    entered = state.join(entry, state["conv_id"].eqNullSafe(F.col("_c")) & (state["ix"] == F.col("_ix")))

    def letters():
        steps = Steps()

        def each(row):
            vectors = steps.run(row["codes"], tuple(row["right"]))
            cost = row["off"] + (row["left"][START] if row["ix"] == 1 else 0)
            return row["conv_id"], row["segment"], cost, steps.trace(row["codes"], vectors, row["state"])[0]
        return each

    columns = entered.select("conv_id", "segment", "ix", "codes", "right", "left", "off", "state")
    done = _map_rows(columns, f"conv_id {kind}, segment long, cost long, letters string", letters)
    idle = parts.filter(~active).select(
        "conv_id", "segment", (DELETE * F.length("codes")).cast("long").alias("cost"), F.expr("repeat('D', length(codes))").alias("letters"))
    return done.unionByName(idle), passes


def _replay(rows: DataFrame, kind: str) -> DataFrame:
    """audit, repaired_sha256 and illegal per conversation, from its segments' letters and its rows in order.

    A conversation passes through one task as a stream, for the digest goes over all of its text; only its letters are held.
    """
    schema = f"conv_id {kind}, illegal long, audit string, repaired_sha256 string"
    kinds = (None, pa.int64(), pa.string(), pa.string())

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Talk:
            def __init__(self, conv):
                self.conv, self.state, self.audit, self.sha, self.any = conv, START, [], hashlib.sha256(), False
                self.letters, self.at, self.last, self.illegal = "", 0, None, 0

            def say(self, role, text):
                self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
                self.any = True

            def insert(self):
                initial, self.state = WANTED[self.state]
                self.say(ROLES[initial], "")

            def row(self, role, text):
                if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
                    self.illegal += 1
                self.last = role[:1]
                while self.letters[self.at] == "I":
                    self.insert()
                    self.at += 1
                letter = self.letters[self.at]
                self.at += 1
                if letter == "K":
                    self.state = NEXT[role[:1]][self.state]
                    self.say(role, text)
                elif letter == "R":
                    initial, self.state = WANTED[self.state]
                    self.say(ROLES[initial], text)

            def result(self):
                while END[self.state]:
                    self.insert()
                    self.audit.append("I")
                return self.conv, self.illegal, "".join(self.audit), self.sha.hexdigest()

        talk, out = None, []
        for batch in stream:
            conv_type = batch.column(0).type
            for conv, letters, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if talk is None or talk.conv != conv:
                    if talk is not None:
                        out.append(talk.result())
                    talk = Talk(conv)
                if letters is not None:
                    talk.letters, talk.at = letters, 0
                    talk.audit.append(letters)
                else:
                    talk.row(role, text)
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k or conv_type) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in schema.split(", ")])
                out = []
        if talk is not None:
            out.append(talk.result())
            yield pa.RecordBatch.from_arrays([pa.array(c, k or conv_type) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(work, schema)


def repaired(conversations: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults of each conversation, and the cheapest edits that give it a lawful order of roles.

    ``rows`` has conv_id, turn, role and text, the last two without nulls; ``conversations`` names all conv_id that get a result, a null one is one conversation.
    Rows are taken by turn, null first; rows of one turn by role initial and digest, so repeated rows stand together. The first
    fault of a row counts: blank, duplicate of role and text, truncated (no closing mark at its end). Blank rows and duplicates go for 3, others may be kept,
    get the role user or assistant for 2, or go for 3; an empty row may come in anywhere for 2, and a truncated one that stays adds 1. Ties go to the edits whose
    initials are least. A conversation without rows has zeros, no edits and the digest of the empty string. Roles that do not start
    with s, u or a can not be kept. Columns other than these four are not looked at.
    """
    placed = pin(_placed(rows), "viterbi-rows")
    slim = placed.select(
        "conv_id", "pos", "key", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(WORD_PATTERN)).alias("is_blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("is_open"))
    parts = pin(segments(slim, chunk), "viterbi-segments")
    solved, _ = solve(parts)
    solved = pin(solved, "viterbi-letters")

    cut = F.shiftright("pos", 33) * (1 << 33) + F.floor(F.pmod("pos", F.lit(1 << 33)) / chunk)
    texts = placed.select("conv_id", cut.alias("segment"), "pos", F.lit(None).cast("string").alias("letters"), "role", "text")
    said = solved.select("conv_id", "segment", F.lit(-1).cast("long").alias("pos"), "letters", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = texts.unionByName(said).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment", "pos")
    kind = rows.schema["conv_id"].dataType.simpleString().replace("bigint", "long")
    replayed = _replay(stream.select("conv_id", "letters", "role", "text"), kind)

    turns = placed.select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("_t")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    faults = parts.groupBy(F.col("conv_id").alias("_f")).agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    costs = solved.groupBy(F.col("conv_id").alias("_s")).agg(F.sum("cost").alias("cost"))
    out = conversations.select("conv_id").distinct()
    for other, name in ((turns, "_t"), (faults, "_f"), (costs, "_s"), (replayed.withColumnRenamed("conv_id", "_r"), "_r")):
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col(name)), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
