"""Roles of transcript lines by a hidden Markov model, and turns in one canonical form.

A state is a role and whether the line begins a turn or goes on with it. A line shows whether it is the first of its row,
the row's role label, a speaker marker at its beginning, and its form (length, last sign, first sign). Forms and the order
of roles are counted in the corpus; how far labels and markers are trusted is fixed. Viterbi's path through
all lines of a conversation gives the roles.

A conversation may be longer than a task should hold, so it is cut into blocks of rows by their position. A block is first
summed up as the best score from each state before it to each state at its end, 36 numbers; from these follow each block's
entry and exit, with which it is decoded by itself.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.tables import stored
from shelfcast.llm.text import dealt_by, partitions, text_groups

ROLES = ("system", "user", "assistant")
# Names of the roles in labels and markers.
NAMES = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "prompter", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a", "chatbot", "agent"),
}
BY_NAME = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = r"\s*(?:#{1,6}\s*|\*\*|<\|?|\[)?(" + "|".join(sorted(BY_NAME, key=lambda x: (-len(x), x))) + r")\s*(?:\*\*\s*[:>]|[:>\]]\s*\*\*|\|>|[:>\]])\s*"
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"

STATES = 2 * len(ROLES)
#: Rows of a block at most.
BLOCK = 512
FORMS = 6 * 2 * 3
#: That the label or marker of a line that begins a turn names its role, and each other one; else it names none. The same inside a turn.
NAMED, MISNAMED = 0.596, 0.002
NAMED_INSIDE = 0.001
#: That a line that begins a turn is the first of its row, and that one inside a turn is.
FIRST, FIRST_INSIDE = 0.95, 0.01
#: That a turn goes on for another line.
GOES_ON = 0.7


@cache
def marker_pattern():
    return regex.compile(MARKER, regex.IGNORECASE)


def form(line: str) -> int:
    """Length in powers of four, whether it ends as a question, whether it begins as prose, as a list or code, or with another sign."""
    bare = line.strip()
    size = min(5, (len(bare).bit_length() + 1) // 2)
    begin = 0 if bare[:1].isalpha() else 1 if bare[:1] in "-*•`{}<>|#" or bare[:1].isdigit() else 2
    return (size * 2 + bare.endswith(("?", "？"))) * 3 + begin


def role_of(label: str | None) -> int:
    """The number of the role that a label names, or -1."""
    return BY_NAME.get((label or "").strip().lower(), -1)


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


class Model:
    """Log-probabilities. forms: role x form. start: role. follows: role x role, for the next turn."""

    def __init__(self, forms: np.ndarray, start: np.ndarray, follows: np.ndarray):
        share = lambda n: np.log((n + 1.0) / (n + 1.0).sum(axis=-1, keepdims=True))
        self.forms, start, follows = share(forms), share(start), share(follows)
        n = len(ROLES)
        self.start = np.full(STATES, -np.inf)
        self.start[:n] = start
        # States: beginnings of turns by role, then insides by role.
        self.moves = np.full((STATES, STATES), -np.inf)
        for k in range(n):
            for state in (k, n + k):
                self.moves[state, :n] = follows[k] + np.log(1 - GOES_ON)
                self.moves[state, n + k] = np.log(GOES_ON)
        other = n - 1
        name = np.log(np.full((STATES, n + 1), MISNAMED))
        for k in range(n):
            name[k, k], name[k, n] = np.log(NAMED), np.log(1 - NAMED - other * MISNAMED)
        name[n:, :n], name[n:, n] = np.log(NAMED_INSIDE), np.log(1 - n * NAMED_INSIDE)
        self.name = name
        first = np.array([FIRST] * n + [FIRST_INSIDE] * n)
        self.first = np.log(np.stack([1 - first, first]))

    def emissions(self, forms: np.ndarray, first: np.ndarray, label: np.ndarray, marker: np.ndarray) -> np.ndarray:
        """Lines x states. label and marker: the number of a role, or -1; only first lines have a label."""
        out = self.first[first.astype(int)] + self.name[:, marker].T + np.tile(self.forms[:, forms].T, 2)
        out[first] += self.name[:, label[first]].T
        return out


def carry(scores: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One line further. scores: ... x states. Returns the scores and the best state before each."""
    paths = scores[..., :, None] + moves
    return paths.max(axis=-2) + emitted, paths.argmax(axis=-2)


class Block:
    """The rows of a block of a conversation, in order, with their lines."""

    def __init__(self, rows: list[tuple], model: Model):
        self.rows = rows
        self.lines = [line for _, _, text in rows for line in lines_of(text)]
        self.row = np.array([k for k, (_, _, text) in enumerate(rows) for _ in lines_of(text)])
        first = np.concatenate([[True], self.row[1:] != self.row[:-1]])
        label = np.array([role_of(role) for _, role, _ in rows])[self.row]
        self.found = [marker_pattern().match(line) for line in self.lines]
        self.marker = np.array([BY_NAME[m[1].lower()] if m else -1 for m in self.found])
        self.forms = np.array([form(line[m.end() :] if m else line) for line, m in zip(self.lines, self.found)])
        self.emitted = model.emissions(self.forms, first, label, self.marker)
        self.model = model

    def summary(self) -> np.ndarray:
        """Best score from each state before the block to each state of its last line."""
        scores = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for emitted in self.emitted:
            scores, _ = carry(scores, self.model.moves, emitted)
        return scores

    def opening(self) -> np.ndarray:
        """Best score of each state of the last line if the conversation begins here."""
        scores = self.model.start + self.emitted[0]
        for emitted in self.emitted[1:]:
            scores, _ = carry(scores, self.model.moves, emitted)
        return scores

    def path(self, entry: np.ndarray | None, last: int | None) -> list[int]:
        """The best states. entry: scores of the states before the block, none at the beginning. last: the state of the last line, if it is known."""
        scores, back = self.model.start + self.emitted[0], []
        if entry is not None:
            scores, before = carry(entry, self.model.moves, self.emitted[0])
        for emitted in self.emitted[1:]:
            scores, before = carry(scores, self.model.moves, emitted)
            back.append(before)
        state = int(scores.argmax()) if last is None else last
        out = [state]
        for before in reversed(back):
            state = int(before[state])
            out.append(state)
        return out[::-1]

    def turns(self, path: list[int]) -> list[tuple]:
        """(row, part, role, continued, lines, rendered): pieces of rows, cut where a turn begins."""
        out: list[list] = []
        n = len(ROLES)
        for k, (state, line, found) in enumerate(zip(path, self.lines, self.found)):
            begins = state < n
            fresh = k == 0 or self.row[k] != self.row[k - 1]
            if found and begins and self.marker[k] == state:
                line = line[found.end() :]
            if begins or fresh:
                part = 0 if fresh else out[-1][1] + 1
                out.append([int(self.row[k]), part, ROLES[state % n], not begins, [line]])
            else:
                out[-1][4].append(line)
        return [(row, part, role, on, len(lines), TEMPLATE.format(role=role, text="\n".join(lines).rstrip())) for row, part, role, on, lines in out]


def chained(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray | None, int]]:
    """For the blocks of a conversation in order (number, summary, opening): number, entry scores, state at the end."""
    entries, scores = [], None
    for _, summary, opening in blocks:
        entries.append(scores)
        scores = opening if scores is None else (scores[:, None] + summary).max(axis=0)
    last, out = int(scores.argmax()), []
    for (number, summary, _), entry in zip(reversed(blocks), reversed(entries)):
        out.append((number, entry, last))
        if entry is not None:
            last = int((entry + summary[:, last]).argmax())
    return out[::-1]


def learn(rows: DataFrame) -> Model:
    """Count forms by role, first roles and following roles over all rows whose label names a role.

    rows: conv_id, block, place, role, text. Followers are counted inside blocks and across
    their borders. A few numbers reach the driver.
    """

    def count(batches):
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (k := role_of(label)) >= 0:
                    for line in lines_of(text):
                        m = marker_pattern().match(line)
                        key = (k, form(line[m.end() :] if m else line))
                        found[key] = found.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([key[0] for key in found], pa.int32()), pa.array([key[1] for key in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["role", "form", "n"])

    forms = np.zeros((len(ROLES), FORMS))
    for x in rows.select("role", "text").mapInArrow(count, "role int, form int, n long").groupBy("role", "form").agg(F.sum("n").alias("n")).collect():
        forms[x.role, x.form] = x.n
    label = F.lower(F.trim("role"))
    number = F.coalesce(*(F.when(label.isin(*NAMES[role]), k) for k, role in enumerate(ROLES)))
    turns = rows.select("conv_id", "block", F.struct("place", number.alias("k")).alias("x"))
    # The rows of a block are bounded by its size.
    runs = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = runs.select(F.explode(F.expr("CASE WHEN size(xs) > 1 THEN transform(sequence(0, size(xs) - 2), i -> struct(get(xs, i).k AS a, get(xs, i + 1).k AS b)) ELSE array() END")).alias("p"))
    # Of a conversation only the ends of its blocks come together.
    ends = turns.groupBy("conv_id", "block").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    following = F.lead("first").over(Window.partitionBy("conv_id").orderBy("block"))
    pairs = pairs.unionByName(ends.select(F.struct(F.col("last.k").alias("a"), following["k"].alias("b")).alias("p")))
    pairs = pairs.where("p.a IS NOT NULL AND p.b IS NOT NULL")
    follows, start = np.zeros((len(ROLES), len(ROLES))), np.zeros(len(ROLES))
    for x in pairs.groupBy("p.a", "p.b").count().collect():
        follows[x.a, x.b] = x["count"]
    opening = turns.groupBy("conv_id").agg(F.min("x").alias("x")).where("x.k IS NOT NULL").groupBy("x.k").count()
    for x in opening.collect():
        start[x.k] = x["count"]
    return Model(forms, start, follows)


def placed(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The distinct rows in order, with how often each occurs: conv_id, turn, role, text, copies, place and block.

    Places rise in the order of all rows, with a gap after each range of the sort. A block is cut by places, so it has
    `block` rows at most, whatever the turns and conversations are numbered.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # Equal rows are counted before they are dealt, so that no number of copies makes a large group.
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn")]
    for c in ("text", "role"):
        order += [F.coalesce(c, F.lit("")), F.col(c).isNotNull()]
    ordered = rows.repartitionByRange(partitions(conversations), *order).sortWithinPartitions(*order)
    # Written, as places are only the same in one run.
    numbered, _ = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "turns")
    return numbered.withColumn("block", F.expr(f"place div {block}"))


def format_turns(conversations: DataFrame, block: int = BLOCK, model: Model | None = None) -> DataFrame:
    """Roles recovered and turns rendered: conv_id, turn, part, given_role, role, continued, n_lines, rendered.

    conversations: conv_id, turn, role, text. One row per piece of a row, cut where a turn begins inside it; a
    piece that goes on with the turn before it is marked as continued. A speaker marker is removed where it names the
    role found. Turns are ordered by number, null first; rows that share one by text, then role. Rows equal in all
    four columns follow each other and are rendered alike, each of them. Null or empty texts are one empty line, unknown and null roles no label. Rows without
    conv_id are one conversation. An empty table gives no rows; other columns are left out.
    """
    groups = text_groups(conversations)
    rows = placed(conversations, block).withColumn("grp", F.expr(f"cast(pmod(xxhash64(conv_id, block), {groups}) AS int)"))
    model = model or learn(rows)
    dealt = dealt_by(rows, groups, "grp")

    def blocks(table: pa.Table) -> list[tuple[tuple, Block]]:
        found: dict[tuple, list[tuple]] = {}
        for conv, number, place, turn, role, text in zip(*(table.column(c).to_pylist() for c in ("conv_id", "block", "place", "turn", "role", "text"))):
            found.setdefault((conv, number), []).append((place, (turn, role, text)))
        return [(key, Block([row for _, row in sorted(own, key=lambda r: r[0])], model)) for key, own in found.items()]

    def summarize(table: pa.Table) -> pa.Table:
        found = [(conv, number, b.summary().tobytes(), b.opening().tobytes()) for (conv, number), b in blocks(table)]
        return _table(found, SUMMARIES)

    def chain(table: pa.Table) -> pa.Table:
        found: dict[int | None, list[tuple]] = {}
        for conv, number, summary, opening in zip(*(table.column(c).to_pylist() for c in ("conv_id", "block", "summary", "opening"))):
            found.setdefault(conv, []).append((number, np.frombuffer(summary).reshape(STATES, STATES), np.frombuffer(opening)))
        out = [(conv, number, b"" if entry is None else entry.tobytes(), last) for conv, own in found.items() for number, entry, last in chained(sorted(own, key=lambda b: b[0]))]
        return _table(out, ENTRIES)

    def decode(turns: pa.Table, entries: pa.Table) -> pa.Table:
        known = {(conv, number): (np.frombuffer(entry) if entry else None, last) for conv, number, entry, last in zip(*(entries.column(c).to_pylist() for c in ("conv_id", "block", "entry", "last")))}
        copies = {(conv, number, place): n for conv, number, place, n in zip(*(turns.column(c).to_pylist() for c in ("conv_id", "block", "place", "copies")))}
        places: dict[tuple, list[int]] = {}
        for conv, number, place in sorted(copies, key=lambda key: key[2]):
            places.setdefault((conv, number), []).append(place)
        out = []
        for (conv, number), b in blocks(turns):
            for row, part, role, on, n, rendered in b.turns(b.path(*known[conv, number])):
                turn, given, _ = b.rows[row]
                out.append((conv, turn, part, given, role, on, n, rendered, copies[conv, number, places[conv, number][row]]))
        return _table(out, RENDERED)

    summaries = dealt.groupBy("grp").applyInArrow(summarize, "conv_id long, block long, summary binary, opening binary")
    # Of a conversation only its blocks' summaries come together.
    hashed = dealt_by(summaries.withColumn("owner", F.expr(f"cast(pmod(xxhash64(conv_id), {groups}) AS int)")), groups, "owner")
    entries = hashed.groupBy("owner").applyInArrow(chain, "conv_id long, block long, entry binary, last int")
    entries = dealt_by(entries.withColumn("grp", F.expr(f"cast(pmod(xxhash64(conv_id, block), {groups}) AS int)")), groups, "grp")
    found = dealt.groupBy("grp").cogroup(entries.groupBy("grp")).applyInArrow(
        decode, "conv_id long, turn long, part int, given_role string, role string, continued boolean, n_lines int, rendered string, copies long"
    )
    # As many rows as came in.
    return found.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies", "copy")


SUMMARIES = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("summary", pa.binary()), ("opening", pa.binary())])
ENTRIES = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.binary()), ("last", pa.int32())])
RENDERED = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("given_role", pa.string()), ("role", pa.string()), ("continued", pa.bool_()), ("n_lines", pa.int32()), ("rendered", pa.string()), ("copies", pa.int64())]
)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([row[k] for row in rows], field.type) for k, field in enumerate(schema)], schema=schema)
