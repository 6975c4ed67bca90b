"""Repair of conversations whose rows were damaged: the cheapest edits that make the roles alternate.

A legal conversation is empty, or pairs of user and assistant behind at most one system
row. Each row is kept, given another role, or deleted; edits have costs. Each edit is an
arc of a graph from state to state of that grammar, and weighs one integer: its cost in
the high digits, its letter in the digit of its row. So the least sum of arcs is the
cheapest repair and, of equally cheap ones, that whose letters come first.

An empty row could be inserted, too. That is never cheapest while it costs more than two
deletions: without the pair that it completes there is one deletion in its place, or two if
a system row then stands alone. Such costs are required, so that row i always has digit i.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from splitloom.llm.common import kept

#: ASCII white space; `rtrim` and `strip` take it as a set.
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = "DIKR"
#: A digit has three bits; the end of a string counts as zero, so letters are one to four.
DIGIT = 3
DIGITS = {DELETE: 1, INSERT: 2, KEEP: 3, REROLE: 4}
#: Initials of the roles, and faults, in the order of their numbers; a row's code is four times the one plus the other.
INITIALS, FAULTS = ("s", "u", "a", ""), ("", "truncated", "duplicate", "blank")
#: States of the grammar: nothing yet, after system, after user, after assistant. Where an initial leads.
STATES, START, ENDS = 4, 0, (0, 3)
FOLLOWS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
ROLES = {2: "user", 3: "assistant"}
#: Rows whose paths one task weighs at once.
SEGMENT_ROWS = 4_096


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: Of a truncated row that stays.
    truncated: int = 5

    def __post_init__(self) -> None:
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert <= 2 * self.delete:
            raise ValueError("an insertion must cost more than two deletions, and nothing less than zero")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text), damaged as crc32 of `conv_id:turn` says; NULL counts as one space.

    Of twenty remainders 0 drops a row, 1 empties its text, 2 takes . ! ? out of it, 3 repeats
    it, 4 makes its role user.
    """

    def shown(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), hit.alias("hit"))
    return rows.where("hit != 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """The rows with `at`, which rises along each conversation, written out.

    A conversation may fill many partitions. Equal rows are spread by their place in the input.
    """
    rows = turns.select(
        "conv_id", "turn", "role", "text", F.left("text", F.lit(64)).alias("head"), F.sha2("text", 256).alias("digest"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ("conv_id", "turn", "role", "head", "digest", "place")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", "text", "digest")
    return kept(numbered, "conversations")


def _segments(ordered: DataFrame, rows: int) -> DataFrame:
    """(conv_id, block, codes): initial and first fault of each row, up to so many rows of a conversation."""
    firsts = ordered.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"))
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = ordered.select(
        "at", "conv_id", number.alias("initial"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    found = narrow.join(firsts.select("at", F.lit(True).alias("first")), "at", "left")
    fault = F.when(F.col("blank"), 3).when(F.col("first").isNull(), 2).when(F.col("cut"), 1).otherwise(0)
    coded = found.select("at", "conv_id", F.expr(f"at div {rows}").alias("block"), (F.col("initial") * 4 + fault).alias("code"))
    listed = F.sort_array(F.collect_list(F.struct("at", "code")))
    return coded.groupBy("conv_id", "block").agg(listed.getField("code").alias("codes"))


def arcs(costs: Costs) -> list[list[list[tuple[int, int, int]]]]:
    """By code and state: (cost, digit, next state) of every edit."""
    found = []
    for initial in INITIALS:
        for fault in FAULTS:
            by_state = []
            for state in range(STATES):
                own = [(costs.delete, DIGITS[DELETE], state)]
                if fault not in ("blank", "duplicate"):
                    more = costs.truncated if fault else 0
                    if state in FOLLOWS[initial]:
                        own.append((more, DIGITS[KEEP], FOLLOWS[initial][state]))
                    own += [
                        (more + costs.rerole, DIGITS[REROLE], FOLLOWS[role][state]) for role in "ua" if state in FOLLOWS[role]
                    ]
                by_state.append(own)
            found.append(by_state)
    return found


def path_weights(codes: list[int], table: list) -> list[int | None]:
    """The least weight of a path over the rows from each state to each state, row by row of a 4 x 4 matrix."""
    width, weights = DIGIT * len(codes), []
    for start in range(STATES):
        best: list[int | None] = [None] * STATES
        best[start] = 0
        for number, code in enumerate(codes):
            shift = DIGIT * (len(codes) - 1 - number)
            following: list[int | None] = [None] * STATES
            for state, weight in enumerate(best):
                if weight is not None:
                    for cost, digit, to in table[code][state]:
                        total = weight + (cost << width) + (digit << shift)
                        if following[to] is None or total < following[to]:
                            following[to] = total
            best = following
        weights += best
    return weights


def letters_of(weight: int, rows: int) -> str:
    """The edits that a path's weight spells."""
    back = {digit: letter for letter, digit in DIGITS.items()}
    return "".join(back[weight >> DIGIT * (rows - 1 - n) & 7] for n in range(rows))


def _to_bytes(weight: int | None) -> bytes | None:
    return None if weight is None else weight.to_bytes(weight.bit_length() // 8 + 1, "big")


def _from_bytes(weight: bytes | None) -> int | None:
    return None if weight is None else int.from_bytes(weight, "big")


def _weighed(segments: DataFrame, costs: Costs) -> DataFrame:
    """Adds `paths`, the weights of each segment's paths, and `rest`, the least cost behind it from each state (-1: none).

    The paths of a long conversation's segments are found side by side; only their costs
    are then added up from its end.
    """
    table = arcs(costs)
    id_type = to_arrow_type(segments.schema["conv_id"].dataType)
    columns = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, block long, codes array<int>, paths array<binary>"

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[_to_bytes(w) for w in path_weights(codes, table)] for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch.column("conv_id"), "block": batch.column("block"), "codes": batch.column("codes"),
                    "paths": pa.array(found, pa.list_(pa.binary())),
                }
            )

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rest = object(), []
        for batch in batches:
            out = []
            for name, codes, weights in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "paths"))):
                if name != current:
                    current, rest = name, [0 if state in ENDS else -1 for state in range(STATES)]
                out.append(rest)
                high = [-1 if w is None else _from_bytes(w) >> DIGIT * len(codes) for w in weights]
                rest = [
                    min((c + r for c, r in zip(high[s * STATES :], rest) if c >= 0 and r >= 0), default=-1)
                    for s in range(STATES)
                ]
            arrays = [batch.column(c) for c in ("conv_id", "block", "codes", "paths")]
            names = ["conv_id", "block", "codes", "paths", "rest"]
            yield pa.RecordBatch.from_arrays([arrays[0].cast(id_type), *arrays[1:], pa.array(out, pa.list_(pa.int64()))], names)

    weighed = segments.mapInArrow(paths, columns)
    backwards = weighed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    return backwards.mapInArrow(rests, f"{columns}, rest array<bigint>")


REPAIRED = "conv_id {id}, turn {turn}, role string, text string, fault string, edit string, new_role string, cost long"


def repair(
    turns: DataFrame, conversations: DataFrame | None = None, costs: Costs = Costs(), segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Every row of (conv_id, turn, role, text) with its first fault and its edit.

    Rows come in the order of turn (NULLs first), then role and text; those of one
    conversation are neighbours in one partition. `fault` is blank, duplicate, truncated
    or ''; `edit` is K, R or D; `new_role` is the role after it, NULL if deleted; `cost` is
    that of the edit. An id of `conversations` without rows gives one row with NULLs.

    NULL role or text counts as one space. A NULL id is an id of its own. Repeated rows
    are duplicates. An empty table gives no rows. Further columns are left out. A long
    conversation is ordered over many partitions and its paths are weighed in segments;
    one task then passes over its rows without holding them.
    """
    rows = turns.select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    ids = (rows if conversations is None else conversations).select("conv_id").groupBy("conv_id").agg(F.lit(0).alias("kind"))
    ordered = _ordered(rows)
    weighed = _weighed(_segments(ordered, segment_rows), costs)
    texts = ordered.select("conv_id", F.expr(f"at div {segment_rows}").alias("block"), F.lit(2).alias("kind"), "at", "turn", "role", "text")
    parts = ids.unionByName(weighed.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    stream = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "kind", "at")
    schema = REPAIRED.format(**{k: turns.schema[c].dataType.simpleString() for k, c in (("id", "conv_id"), ("turn", "turn"))})
    types = [to_arrow_type(turns.schema[c].dataType) for c in ("conv_id", "turn")] + [pa.string()] * 5 + [pa.int64()]
    names = ["conv_id", "turn", "role", "text", "fault", "edit", "new_role", "cost"]
    prices = arcs(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is open: the conversation, whether a row of it came, the state, the edits of its segment.
        name, bare, state = None, False, START
        edits: Iterator[tuple[int, str]] = iter(())
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "codes", "paths", "rest"))):
                kind, conv_id, turn, role, text, codes, paths, rest = row
                if kind == 0:
                    if bare:
                        out.append((name, None, None, None, None, None, None, None))
                    name, bare, state = conv_id, True, START
                elif kind == 1:
                    width = DIGIT * len(codes)
                    from_here = [_from_bytes(w) for w in paths[state * STATES : (state + 1) * STATES]]
                    chosen = min(w + (r << width) for w, r in zip(from_here, rest) if w is not None and r >= 0)
                    edits = iter(zip(codes, letters_of(chosen, len(codes))))
                else:
                    bare = False
                    code, edit = next(edits)
                    options = [a for a in prices[code][state] if a[1] == DIGITS[edit]]
                    cost, _, state = options[0]
                    new_role = {DELETE: None, KEEP: role}.get(edit, ROLES.get(state))
                    out.append((conv_id, turn, role, text, FAULTS[code % 4], edit, new_role, cost))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, types)], names)
        if bare:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, *[None] * 7), types)], names)

    return stream.mapInArrow(run, schema)


SUMMARY = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


class Summary:
    """Running figures of one conversation."""

    def __init__(self) -> None:
        self.rows = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.low = self.high = None
        self.turns = self.illegal = self.cost = 0
        self.before = None
        self.audit: list[str] = []
        self.hash, self.lines = sha256(), 0

    def add(self, turn: int | None, role: str, text: str, fault: str, edit: str, new_role: str | None, cost: int) -> None:
        if self.rows and (self.before or "") + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows, self.before = self.rows + 1, role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.faults[fault] += 1
        self.audit.append(edit)
        self.cost += cost
        if new_role is not None:
            self.hash.update((("\n" if self.lines else "") + f"{new_role}:{text}").encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        found = [self.faults[f] for f in ("blank", "duplicate", "truncated")]
        return (gaps, *found, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def summaries(repaired: DataFrame) -> DataFrame:
    """One row per conversation over what `repair` gives, whose partitions and order it needs as they are.

    `gaps` are turn numbers that are missing between the least and the largest; `illegal`
    counts neighbours that no legal conversation has; `audit` holds the edits in order,
    a letter per row; the digest is that of the lines `role:text` after the repair.
    """
    id_type = to_arrow_type(repaired.schema["conv_id"].dataType)
    types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, current = None, None
        for batch in batches:
            out = []
            for conv_id, edit, *row in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "role", "text", "fault", "new_role", "cost"))
            ):
                if current is None or conv_id != name:
                    if current is not None:
                        out.append((name, *current.row()))
                    name, current = conv_id, Summary()
                if edit is not None:
                    turn, role, text, fault, new_role, cost = row
                    current.add(turn, role, text, fault, edit, new_role, cost)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 9, types)], names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, *current.row()), types)], names)

    return repaired.mapInArrow(run, SUMMARY.format(id=repaired.schema["conv_id"].dataType.simpleString()))
