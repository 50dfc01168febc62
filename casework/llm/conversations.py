"""Conversation structure repair: the cheapest edits that turn a conversation's roles into ``(s?(ua)+)?``, with their audit.

Edits walk an automaton of four states (nothing yet, after system, user, assistant). For every row and state the dynamic
programme keeps the cheapest audit, the ASCII-least of equal cost. Audits are paths in a persistent tree: a node adds a few
letters to its parent, so prefixes are shared and a step costs no copy. Equal costs compare by the longest common prefix:
binary search over its length, with prefix hashes found through binary-lifting ancestors; a prefix found by hash is verified
letter by letter up to the paths' common node, and a collision falls back to the plain strings.
(Of two audits of one cost over the same rows none is a prefix of the other, so the least prefix stays least.)

At scale a conversation is cut into segments of at most ``SEGMENT`` rows. Rows without their texts are range-partitioned
by conversation and turn, so a hot conversation spans many tasks; each segment gives the cheapest audit from every
state it may be entered in to every state it may be left in, and a conversation's segments are joined by the same
programme, whose nodes then add a segment's letters. First occurrences come from a partially aggregated group by.

Order of a conversation's rows: turn (nulls first), then the digest of role and text, a damaged row's repetition after it.
Defined results: a null conversation id is a conversation; null role or text counts as one space; a role without first letter
s, u or a (an empty one too) must be reroled or deleted; repeated rows are duplicates; an empty table gives no rows; extra
columns are not read. Very long texts are hashed whole. ``digests`` streams each conversation's texts in order through one hash, which
SHA-256 does not let split, in bounded memory; ``repaired`` deals a hot conversation's rows over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import column, map_arrow, materialize

SEGMENT = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua-"  # the last stands for any other
#: Cheapest insertions that lead from one state to another.
INSERTS = {START: {START: "", USER: "I", ASSISTANT: "II"}, SYSTEM: {SYSTEM: "", USER: "I", ASSISTANT: "II"},
           USER: {USER: "", ASSISTANT: "I"}, ASSISTANT: {ASSISTANT: "", USER: "I"}}
INSERT, REROLE, DELETE, KEEP_TRUNCATED = 3, 3, 4, 3
MOD, BASE = (1 << 61) - 1, 1_000_003
MEMO = 20_000


def _row_steps() -> list[dict[int, list[tuple[int, int, str]]]]:
    """For every row code (initial * 4 + fault): target state -> (source state, cost, letters), insertions before the row included."""
    out = []
    for code in range(16):
        initial, fault = INITIALS[code // 4], code % 4
        edits = [(s, s, DELETE, "D") for s in range(4)]
        if fault not in (BLANK, DUPLICATE):
            extra = KEEP_TRUNCATED if fault == TRUNCATED else 0
            users, assistants = [START, SYSTEM, ASSISTANT], [USER]
            edits += [(s, USER, extra + (0 if c == "K" else REROLE), c) for s in users for c in ("KR" if initial == "u" else "R")]
            edits += [(s, ASSISTANT, extra + (0 if c == "K" else REROLE), c) for s in assistants for c in ("KR" if initial == "a" else "R")]
            if initial == "s":
                edits.append((START, SYSTEM, extra, "K"))
        best = {}
        for source, ways in INSERTS.items():
            for mid, ins in ways.items():
                for at, target, cost, letter in edits:
                    if at == mid:
                        new = (cost + INSERT * len(ins), ins + letter)
                        best[source, target] = min(best.get((source, target), new), new)
        steps: dict[int, list[tuple[int, int, str]]] = {}
        for (source, target), (cost, letters) in best.items():
            steps.setdefault(target, []).append((source, cost, letters))
        out.append(steps)
    return out


ROW_STEPS = _row_steps()


class Audits:
    """A persistent tree of audits: node 0 is empty, every other adds letters to its parent."""

    def __init__(self, mod: int = MOD):
        self.mod = mod
        self.parent, self.letters, self.length, self.hash, self.up = [0], [""], [0], [0], [[0]]

    def _roll(self, h: int, letters: str) -> int:
        for c in letters:
            h = (h * BASE + ord(c)) % self.mod
        return h

    def add(self, parent: int, letters: str) -> int:
        """A child of ``parent`` with one or more further letters."""
        n = len(self.parent)
        self.parent.append(parent)
        self.letters.append(letters)
        self.length.append(self.length[parent] + len(letters))
        self.hash.append(self._roll(self.hash[parent], letters))
        up, k = [parent], 0
        while k < len(self.up[up[k]]) and up[k]:  # the ancestor 2^(k+1) up is that of the one 2^k up
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        return n

    def _holder(self, node: int, size: int) -> int:
        """The ancestor (or the node) whose letters reach the prefix of ``size`` letters."""
        if self.length[self.parent[node]] < size:
            return node
        for k in range(len(self.up[node]) - 1, -1, -1):
            if k < len(self.up[node]) and self.length[self.up[node][k]] >= size:
                node = self.up[node][k]
        return node if self.length[self.parent[node]] < size else self.parent[node]

    def prefix_hash(self, node: int, size: int) -> int:
        if size == 0:
            return 0
        h = self._holder(node, size)
        return self._roll(self.hash[self.parent[h]], self.letters[h][:size - self.length[self.parent[h]]])

    def letter(self, node: int, at: int) -> str:
        h = self._holder(node, at + 1)
        return self.letters[h][at - self.length[self.parent[h]]]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def _tail(self, node: int, other: int, size: int) -> tuple[str, str]:
        """The first ``size`` letters of both audits after the paths' common node."""
        a, b, x, y = [], [], node, other
        while x != y:
            if self.length[x] >= self.length[y]:
                a.append(self.letters[x])
                x = self.parent[x]
            else:
                b.append(self.letters[y])
                y = self.parent[y]
        rest = max(0, size - self.length[x])
        return "".join(reversed(a))[:rest], "".join(reversed(b))[:rest]

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of ``a`` is ASCII-less than that of ``b``."""
        if a == b:
            return False
        low, high = 0, min(self.length[a], self.length[b])
        while low < high:  # longest common prefix by hashes
            mid = (low + high + 1) // 2
            if self.prefix_hash(a, mid) == self.prefix_hash(b, mid):
                low = mid
            else:
                high = mid - 1
        x, y = self._tail(a, b, low)
        if x != y:  # a collision
            return self.text(a) < self.text(b)
        if low == min(self.length[a], self.length[b]):
            return self.length[a] < self.length[b]
        return self.letter(a, low) < self.letter(b, low)


def _advance(tree: Audits, now: dict[int, tuple[int, int]], steps: dict[int, list[tuple[int, int, str]]]) -> dict[int, tuple[int, int]]:
    """The cheapest audits by state after one more row or segment."""
    after = {}
    for target, ways in steps.items():
        best = None
        for source, cost, letters in ways:
            if source not in now:
                continue
            total = now[source][0] + cost
            if best is None or total < best[0]:
                best = (total, now[source][1], letters, None)
            elif total == best[0]:
                mine = best[3] if best[3] is not None else tree.add(best[1], best[2])
                new = tree.add(now[source][1], letters)
                best = (total, now[source][1], letters, new) if tree.less(new, mine) else (*best[:3], mine)
        if best is not None:
            after[target] = (best[0], best[3] if best[3] is not None else tree.add(best[1], best[2]))
    return after


def segment_table(codes: bytes, entries: tuple[int, ...], mod: int = MOD) -> list[tuple[int, int, int, str]]:
    """(entry state, exit state, cost, audit) of the cheapest edits of a run of rows."""
    out = []
    for entry in entries:
        tree = Audits(mod)
        now = {entry: (0, 0)}
        for c in codes:
            now = _advance(tree, now, ROW_STEPS[c])
        out += [(entry, state, cost, tree.text(node)) for state, (cost, node) in sorted(now.items())]
    return out


class Chain:
    """A conversation's segments, joined one after the other."""

    def __init__(self, mod: int = MOD):
        self.tree, self.now = Audits(mod), {START: (0, 0)}
        self.states: dict[int, int] = {0: START}  # the state in which a node's audit ends

    def add(self, table: list[tuple[int, int, int, str]]) -> None:
        steps: dict[int, list[tuple[int, int, str]]] = {}
        for entry, state, cost, audit in table:
            steps.setdefault(state, []).append((entry, cost, audit))
        self.now = _advance(self.tree, self.now, steps)
        self.states.update({node: state for state, (_, node) in self.now.items()})

    def close(self) -> tuple[int, str, list[tuple[int, str]], str]:
        """Cost, audit, each segment's (entry state, letters), and the insertions at the end."""
        best = None
        for state, (cost, node) in sorted(self.now.items()):
            for last, ins in INSERTS[state].items():
                if last in (START, ASSISTANT):
                    total = cost + INSERT * len(ins)
                    if best is None or total <= best[0]:
                        new = self.tree.add(node, ins) if ins else node
                        if best is None or total < best[0] or self.tree.less(new, best[1]):
                            best = (total, new, node, ins)
        cost, end, node, ins = best
        pieces = []
        while node:
            pieces.append((self.states[self.tree.parent[node]], self.tree.letters[node]))
            node = self.tree.parent[node]
        return cost, self.tree.text(end), pieces[::-1], ins


def plan(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit makes of a conversation's rows."""
    out, at, state = [], 0, START
    it = iter(rows)
    while at < len(audit):
        made, n, state = edit(audit, at, state, next(it) if audit[at:].lstrip("I") else None)
        out += made
        at += n
    return out


def edit(audit: str, at: int, state: int, row: tuple[str, str] | None) -> tuple[list[tuple[str, str]], int, int]:
    """What the letters from ``at`` up to one row's letter (or the closing insertions) make, how many they are, and the state after."""
    out, n = [], 0
    while at + n < len(audit) and audit[at + n] == "I":
        state = ASSISTANT if state == USER else USER
        out.append((_ROLE[state], ""))
        n += 1
    if row is None or at + n >= len(audit):
        return out, n, state
    letter = audit[at + n]
    if letter == "R":
        state = ASSISTANT if state == USER else USER
        out.append((_ROLE[state], row[1]))
    elif letter == "K":
        state = SYSTEM if row[0][:1] == "s" else ASSISTANT if state == USER else USER
        out.append(row)
    return out, n + 1, state


_ROLE = {USER: "user", ASSISTANT: "assistant"}

# ---- rows ---------------------------------------------------------------------------------------

_SOLID = r"[^\x20\x09-\x0D]"


def plain_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy, gone) of a table of conversations, nulls of role and text as one space."""
    return rows.select(column(rows, conv_col).alias("conv"), column(rows, turn_col).cast("long").alias("turn"),
                       F.coalesce(column(rows, role_col), F.lit(" ")).alias("role"), F.coalesce(column(rows, text_col), F.lit(" ")).alias("text"),
                       F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def damaged(rows: DataFrame, **cols: str) -> DataFrame:
    """``plain_rows`` after the contract's damage by crc32 of ``conv_id:turn``."""
    r = plain_rows(rows, **cols)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = r.select("*", (F.crc32(F.encode(F.concat(text("conv"), F.lit(":"), text("turn")), "UTF-8")) % 20).alias("d"))
    d = F.col("d")
    r = r.select("conv", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
                 F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                 F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (d == 0).alias("gone"))
    return r


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(_SOLID), BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), OK).otherwise(TRUNCATED)
    return kind * 4 + fault


ORDER = ("conv", "turn", "digest", "copy")


def coded(rows: DataFrame) -> DataFrame:
    """The rows without texts: order keys and code, duplicates of earlier rows marked (all but those next to an equal row)."""
    k = rows.select("conv", "turn", _digest().alias("digest"), "copy", "gone", _code().alias("code"))
    when = F.struct(F.col("turn").isNotNull().alias("x"), F.coalesce("turn", F.lit(0)).alias("y"), F.col("copy").alias("z"))
    first = k.filter(~F.col("gone") & (F.col("code") % 4 != BLANK)).groupBy("conv", "digest") \
        .agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("g"), "first")
    j = k.join(first, k["conv"].eqNullSafe(first["c"]) & (k["digest"] == first["g"]), "left")
    again = F.col("first").isNotNull() & (F.col("code") % 4 != BLANK) & (when > F.col("first"))
    return j.select("conv", "turn", "digest", "copy", "gone", F.when(again, F.floor(F.col("code") / 4) * 4 + DUPLICATE).otherwise(F.col("code")).cast("int").alias("code"))


def _legal(a: int, b: int) -> bool:
    return INITIALS[a // 4] + INITIALS[b // 4] in ("su", "ua", "au")


_STATS = "n long, lo long, hi long, turns long, first_turn long, last_turn long, first_code int, last_code int, blank long, duplicate long, truncated long, illegal long"
_ROWS = "codes binary, row_turn array<long>, row_digest array<binary>, row_copy array<int>"
_TABLE = "table array<struct<entry: int, state: int, cost: long, audit: string>>"


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a task's rows, made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def segment_rows(size: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, memo = TaskContext.get().partitionId(), 0, {}
        held: list[tuple] = []  # (turn, digest, copy, code) of the open segment
        conv, opened, since, kept_any, previous = None, False, 0, False, None
        ready: list[dict] = []

        def cut() -> dict:
            nonlocal seq, since
            codes = bytes(h[3] for h in held)
            # only a task's first conversation may have begun in another task
            entries = (START,) if since == 0 and kept_any else (START, SYSTEM, USER, ASSISTANT)
            key = codes, entries
            table = memo.get(key)
            if table is None:
                table = [dict(zip(("entry", "state", "cost", "audit"), x)) for x in segment_table(codes, entries)]
                if len(codes) <= 64 and len(memo) < MEMO:
                    memo[key] = table
            turns = [h[0] for h in held if h[0] is not None]
            faults = [c % 4 for c in codes]
            row = {"conv": conv, "part": part, "seq": seq, "n": len(held), "lo": turns[0] if turns else None, "hi": turns[-1] if turns else None,
                   "turns": len(set(turns)), "first_turn": held[0][0] if held else None, "last_turn": held[-1][0] if held else None,
                   "first_code": codes[0] if codes else None, "last_code": codes[-1] if codes else None,
                   "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                   "illegal": sum(not _legal(a, b) for a, b in zip(codes, codes[1:])), "table": table, "codes": codes,
                   "row_turn": [h[0] for h in held], "row_digest": [h[1] for h in held], "row_copy": [h[2] for h in held]}
            seq += 1
            since += len(held)
            held.clear()
            return row

        for b in batches:
            for c, turn, digest, copy, gone, code in zip(*[x.to_pylist() for x in b.columns]):
                if not opened or c != conv:
                    if opened:
                        ready.append(cut())
                        kept_any = True
                    conv, opened, since, previous = c, True, 0, None
                if gone:
                    continue
                if previous == (turn, digest) and code % 4 != BLANK:
                    code = code // 4 * 4 + DUPLICATE  # equal rows lie side by side
                previous = turn, digest
                held.append((turn, digest, copy, code))
                if len(held) == size:
                    ready.append(cut())
                if len(ready) >= 256:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
        if opened:
            ready.append(cut())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)
    return run


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    k = coded(rows)
    keys = [F.asc_nulls_first(c) for c in ORDER]
    k = k.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "digest", "copy", "gone", "code")
    kind = k.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, part int, seq int, {_STATS}, {_TABLE}, {_ROWS}"
    return materialize(map_arrow(k, segment_rows(size, _arrow(ddl)), ddl), "conversation-segments")


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


_CHAINED = ["conv", "part", "seq", *[c.split()[0] for c in _STATS.split(", ")], "table"]


def chain_rows(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, conv, chain, sums, places, ready = False, None, None, None, [], []

        def done() -> list[dict]:
            cost, audit, pieces, ins = chain.close()
            gaps = 0 if sums["lo"] is None else sums["hi"] - sums["lo"] + 1 - sums["turns"]
            out = [{"conv": conv, "kind": 1, "part": p, "seq": s, "entry": e, "letters": x + (ins if i == len(pieces) - 1 else "")}
                   for i, ((p, s), (e, x)) in enumerate(zip(places, pieces))]
            return [{"conv": conv, "kind": 0, "gaps": gaps, "cost": cost, "audit": audit,
                     **{k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}}, *out]

        for b in batches:
            for r in b.to_pylist():
                if not opened or r["conv"] != conv:
                    if opened:
                        ready += done()
                    conv, opened, chain, places = r["conv"], True, Chain(), []
                    sums = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0) | {"lo": None, "hi": None, "last": None}
                if r["n"]:
                    chain.add([(t["entry"], t["state"], t["cost"], t["audit"]) for t in r["table"]])
                    places.append((r["part"], r["seq"]))
                    for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        sums[k] += r[k]
                    if sums["last"] is not None:
                        turn, code = sums["last"]
                        sums["turns"] -= turn is not None and turn == r["first_turn"]
                        sums["illegal"] += not _legal(code, r["first_code"])
                    sums["last"] = r["last_turn"], r["last_code"]
                    sums["lo"] = r["lo"] if sums["lo"] is None else sums["lo"]
                    sums["hi"] = r["hi"] if r["hi"] is not None else sums["hi"]
                if len(ready) >= 1024:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
        if opened:
            ready += done()
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)
    return run


def audits(rows: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The written segments, and the chained results: rows of ``kind`` 0 per conversation, of ``kind`` 1 per segment."""
    segs = segments(rows, size)
    # segments, not rows, of a conversation meet in one task: some letters a row, as in the audit it returns
    s = segs.select(*_CHAINED).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    kind = segs.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, kind int, part int, seq int, entry int, letters string, {_RESULT}"
    return segs, materialize(map_arrow(s, chain_rows(_arrow(ddl)), ddl), "conversation-audits")


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header rows (with the audit) ahead of a conversation's texts: one running hash per conversation."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    head, h, at, state, first, ready = None, None, 0, START, True, []

    def put(made):
        nonlocal first
        for role, text in made:
            h.update((role + ":" + text if first else "\n" + role + ":" + text).encode())
            first = False

    def done():
        made, _, _ = edit(head["audit"], at, state, None)
        put(made)
        return {**{k: head[k] for k in names[:-1]}, "repaired_sha256": h.hexdigest()}
    schema = None
    for b in batches:
        if schema is None:
            schema = pa.schema([*[b.schema.field(n) for n in names[:-1]], pa.field("repaired_sha256", pa.string())])
        heads = {i: b.slice(i, 1).to_pylist()[0] for i, x in enumerate(b.column("header").to_pylist()) if x}
        for i, row in enumerate(zip(b.column("role").to_pylist(), b.column("text").to_pylist())):
            if i in heads:
                if head is not None:
                    ready.append(done())
                head, h, at, state, first = heads[i], hashlib.sha256(), 0, START, True
            else:
                made, n, state = edit(head["audit"], at, state, row)
                at += n
                put(made)
        if len(ready) >= 512:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready = []
    if head is not None:
        ready.append(done())
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def digests(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``plain_rows`` or ``damaged``: faults, cost, audit, and the hash of the repaired rows."""
    _, chained = audits(rows, size)
    heads = chained.filter("kind = 0").select("conv", *[c.split()[0] for c in _RESULT.split(", ")], F.lit(True).alias("header"))
    texts = rows.filter("not gone").select("conv", "turn", _digest().alias("digest"), "copy", "role", "text", F.lit(False).alias("header"))
    d = heads.unionByName(texts, allowMissingColumns=True).repartition("conv") \
        .sortWithinPartitions("conv", F.desc("header"), *[F.asc_nulls_first(c) for c in ORDER[1:]])
    kind = rows.schema["conv"].dataType.simpleString()
    out = map_arrow(d.select("conv", *[c.split()[0] for c in _RESULT.split(", ")], "header", "role", "text"), digest_rows,
                    f"conv {kind}, {_RESULT}, repaired_sha256 string")
    return out.withColumnRenamed("conv", "conv_id")


_EDITS = "turn long, digest binary, copy int, part int, seq int, at int, state int, letters string"


def edit_rows(schema: pa.Schema) -> Callable:
    """Each row's letters (a conversation's closing insertions with its last row) and the state before, from its segment's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out, at, state, letters = [], 0, r["entry"], r["letters"]
                last = len(r["codes"]) - 1
                for i, key in enumerate(zip(r["row_turn"], r["row_digest"], r["row_copy"])):
                    end = at
                    while letters[end] == "I":
                        end += 1
                    end = len(letters) if i == last else end + 1
                    out.append({"conv": r["conv"], "turn": key[0], "digest": key[1], "copy": key[2], "part": r["part"], "seq": r["seq"], "at": i,
                                "state": state, "letters": letters[at:end]})
                    for c in letters[at:end]:
                        if c == "K" and INITIALS[r["codes"][i] // 4] == "s":
                            state = SYSTEM
                        elif c != "D":
                            state = ASSISTANT if state == USER else USER
                    at = end
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits ahead of the rows with the same keys: the rows that they make."""
    from collections import deque
    names = ["conv_id", "part", "seq", "at", "piece", "edit", "turn", "role", "text"]
    waiting: deque = deque()
    for b in batches:
        out = []
        for conv, turn, part, seq, at, state, letters, role, text in zip(*[c.to_pylist() for c in b.columns]):
            if letters is not None:
                waiting.append((part, seq, at, state, letters))
                continue
            part, seq, at, state, letters = waiting.popleft()
            made, n, state = edit(letters, 0, state, (role, text))
            tail, _, _ = edit(letters, n, state, None)
            inserted = len(letters[:n].rstrip("KRD"))
            for k, (new_role, new_text) in enumerate(made + tail):
                letter = "I" if k < inserted or k >= len(made) else letters[n - 1]
                out.append((conv, part, seq, at, k, letter, None if letter == "I" else turn, new_role, new_text))
        if out:
            cols = list(zip(*out))
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def repaired(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The repaired rows of ``plain_rows`` or ``damaged``: ``conv_id``, the order inside it (``part``, ``seq``, ``at``, ``piece``), the
    edit that made the row (K, R or I), ``turn`` (null if inserted), ``role`` and ``text``. Rows are dealt by conversation and turn."""
    segs, chained = audits(rows, size)
    kind = rows.schema["conv"].dataType.simpleString()
    edits = segs.select("conv", "part", "seq", "codes", "row_turn", "row_digest", "row_copy") \
        .join(chained.filter("kind = 1").select("part", "seq", "entry", "letters"), ["part", "seq"])
    edits = map_arrow(edits.select("conv", "part", "seq", "entry", "letters", "codes", "row_turn", "row_digest", "row_copy"), edit_rows(_arrow(f"conv {kind}, {_EDITS}")),
                      f"conv {kind}, {_EDITS}")
    texts = rows.filter("not gone").select("conv", "turn", _digest().alias("digest"), "copy", "role", "text")
    keys = [F.asc_nulls_first(c) for c in ORDER]
    d = edits.unionByName(texts, allowMissingColumns=True).repartitionByRange(*keys) \
        .sortWithinPartitions(*keys, F.col("letters").isNull(), "part", "seq", "at")
    return map_arrow(d.select("conv", "turn", "part", "seq", "at", "state", "letters", "role", "text"), repaired_rows,
                     f"conv_id {kind}, part int, seq int, at int, piece int, edit string, turn long, role string, text string")
