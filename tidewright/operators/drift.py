"""Schemas that drift between files (problem 4).

A layout is a tree of fields.  ``edit_script`` finds the cheapest script of
adds, deletes, renames, moves and changes of type that turns one tree into the
other: siblings, equal names included, are matched by a minimum-cost assignment whose
entries are the edit distances of the subtrees, so order is no change.  A rename costs by how
little two fields agree in meaning; two fields known to differ can't be
matched.  ``compile_script`` turns a script into the projection that reads a
file of the new layout as one of the old: renamed and moved fields under their
old paths, retyped ones cast.

Declared schemas give meaning by description.  For the records of a load it
comes from what is known about names over all loads: what a name was declared
as, which names stand side by side in one layout (and so differ), and what
values they hold.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..session import materialize
from .fieldstats import field_stats

CHANGE = "change_kind string, field_name string, new_name string"
#: JSON types that bear out a declared type; an undeclared or unknown type bears all. (fixed values of the task's statement)
JSON_TYPES = {"str": {"string"}, "datetime": {"string"}, "int": {"number"}, "float": {"number"}, "bool": {"boolean"}}

#: Cost of an added or a deleted node; a match that costs more than both isn't made.
ADD = DELETE = 1.0
NEVER = 1e9

_STOP = frozenset("a an the of to in on for by at from and or is be".split())


@dataclass
class Node:
    """A field: its name, declared type, words of its description, and fields below it."""

    name: str
    kind: str = ""
    meaning: frozenset = frozenset()
    children: list["Node"] = field(default_factory=list)
    #: Extra knowledge for the cost function.
    facts: object = None

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def words_of(text: str | None) -> frozenset:
    """Content words of a description, without case and punctuation."""
    return frozenset(w for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in _STOP)


def name_words(name: str) -> frozenset:
    return frozenset(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name))


def parse_fields(text: str | None) -> list[Node] | None:
    """The fields of a schema: a list of objects, or an object keyed by name; None if unreadable."""
    v = J.read_plain(text)
    if isinstance(v, dict):
        v = [{**x, "name": k} for k, x in v.items() if isinstance(x, dict)]
    if not isinstance(v, list):
        return None
    out: dict[str, Node] = {}
    for x in v:
        if isinstance(x, dict) and isinstance(x.get("name"), str):
            below = x.get("fields")
            kids = parse_fields(below if isinstance(below, str) else J.dump(below)) if below else None
            out[x["name"]] = Node(x["name"], str(x.get("field_type") or ""), words_of(x.get("description") if isinstance(x.get("description"), str) else ""), kids or [])
    return list(out.values())


def assign(cost: list[list[float]]) -> list[int]:
    """Columns assigned to the rows of a square matrix at least total cost (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        match[n], j0 = i, n
        low, prev, used = [float("inf")] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            row, delta, j1 = match[j0], float("inf"), n
            for j in range(n):
                if not used[j]:
                    c = cost[row][j] - u[row] - v[j]
                    if c < low[j]:
                        low[j], prev[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                elif j < n:
                    low[j] -= delta
            j0 = j1
            if match[j0] == n:
                break
        while j0 != n:
            match[j0] = match[prev[j0]]
            j0 = prev[j0]
    out = [0] * n
    for j in range(n):
        out[match[j]] = j
    return out


def edit_script(old: list[Node], new: list[Node], cost, path: str = "") -> tuple[float, list[tuple[str, str, str]]]:
    """(distance, [(change, old name, new name)]) between two lists of sibling trees; names below the top are dotted paths.

    Every pair that costs less than a deletion and an addition is a candidate,
    pairs of equal name among them; candidates that hang together are assigned
    at least cost, so the script is a cheapest one.
    """
    pairs: dict[tuple[int, int], tuple[float, list]] = {}
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            c = _same_name(a, b) if a.name == b.name else cost(a, b)
            if c < DELETE + ADD:
                d, below = edit_script(a.children, b.children, cost, f"{path}{a.name}.") if a.children or b.children else (0.0, [])
                step = [("renamed", path + a.name, b.name)] if a.name != b.name else [("retyped", path + a.name, "")] if a.kind != b.kind else []
                pairs[i, j] = (c + d, step + below)
    total, script, matched_old, matched_new = 0.0, [], set(), set()
    for rows, cols in _components(pairs):
        grid = [[pairs[i, j][0] if (i, j) in pairs else NEVER for j in cols] + [DELETE * old[i].size() if k == i else NEVER for k in rows] for i in rows]
        grid += [[ADD * new[j].size() if k == j else NEVER for k in cols] + [0.0] * len(rows) for j in cols]
        for i, at in zip(rows, assign(grid) if len(grid) > 2 else [0 if grid[0][0] <= grid[0][1] + grid[1][0] else 1]):
            if at < len(cols):
                d, steps = pairs[i, cols[at]]
                total, script = total + d, script + steps
                matched_old.add(i)
                matched_new.add(cols[at])
    for i, a in enumerate(old):
        if i not in matched_old:
            total += DELETE * a.size()
            script.append(("removed", path + a.name, ""))
    for j, b in enumerate(new):
        if j not in matched_new:
            total += ADD * b.size()
            script.append(("added", path + b.name, ""))
    return total, _moves(script)


def _same_name(a: Node, b: Node) -> float:
    """Cost of keeping a name: little, but more than nothing if its meaning has gone elsewhere."""
    off = 1 - len(a.meaning & b.meaning) / len(a.meaning | b.meaning) if a.meaning and b.meaning else 0.0
    return 0.3 * off + (0.5 if a.kind != b.kind else 0.0)


def _components(pairs) -> list[tuple[list[int], list[int]]]:
    """Rows and columns that hang together through candidate pairs."""
    of_row: dict[int, set[int]] = {}
    of_col: dict[int, set[int]] = {}
    for i, j in pairs:
        of_row.setdefault(i, set()).add(j)
        of_col.setdefault(j, set()).add(i)
    out, seen = [], set()
    for start in of_row:
        if start in seen:
            continue
        rows, cols, todo = {start}, set(), [start]
        while todo:
            for j in of_row[todo.pop()] - cols:
                cols.add(j)
                more = of_col[j] - rows
                rows |= more
                todo += more
        seen |= rows
        out.append((sorted(rows), sorted(cols)))
    return out


def _moves(script):
    """A field deleted in one place and added under the same name in another has moved."""
    gone = {s[1].rsplit(".", 1)[-1]: s for s in script if s[0] == "removed" and "." in s[1]}
    out = []
    for s in script:
        g = gone.get(s[1].rsplit(".", 1)[-1]) if s[0] == "added" and "." in s[1] else None
        if g in out:
            out[out.index(g)] = ("moved", g[1], s[1])
        else:
            out.append(s)
    return out


def meaning_cost(a: Node, b: Node) -> float:
    """How little two declared fields agree: by description first, by name where one has none."""
    if a.meaning and b.meaning:
        like = len(a.meaning & b.meaning) / len(a.meaning | b.meaning)
        return 0.2 + (1 - like) + (0.3 if a.kind != b.kind else 0) if like >= 0.67 else NEVER
    x, y = name_words(a.name), name_words(b.name)
    like = len(x & y) / max(1, len(x | y))
    return 0.6 + (1 - like) if a.kind == b.kind and like >= 0.5 else NEVER


def version_changes(schemas: DataFrame) -> DataFrame:
    """(scope_id, change_kind, field_name, new_name) between each schema row and the next lower version of its workspace and name.

    Unreadable ``fields`` are passed over: such a row has no changes and its
    successor is compared with it as with an empty layout only if that can be
    read.  Equal versions are ordered by id.
    """
    w = Window.partitionBy("workspace_id", "name").orderBy("version", "id")
    pairs = schemas.select("id", "workspace_id", "name", "version", "fields").where("id is not null and version is not null")
    pairs = pairs.withColumn("before", F.lag("fields").over(w)).where("before is not null and fields is not null")

    def run(batches):
        for b in batches:
            rows = []
            for sid, new, old in zip(*(b.column(i).to_pylist() for i in range(3))):
                x, y = parse_fields(old), parse_fields(new)
                if x is not None and y is not None:
                    rows += [(sid, *s) for s in edit_script(x, y, meaning_cost)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["scope_id", "change_kind", "field_name", "new_name"])

    return pairs.select("id", "fields", "before").mapInArrow(run, "scope_id string, " + CHANGE)


# ---- loads ----------------------------------------------------------------


class Knowledge:
    """What all loads tell about the names of a scope."""

    def __init__(self):
        self.meanings: dict[tuple[str, str], set[frozenset]] = {}
        self.anywhere: dict[str, set[frozenset]] = {}
        self.beside: dict[tuple[str, str], set[str]] = {}
        self.forms: dict[tuple[str, str], dict[str, float]] = {}
        self.words: dict[tuple[str, str], dict[str, float]] = {}
        self.middle: dict[tuple[str, str], tuple[float, float, float]] = {}

    def declare(self, scope: str, nodes: list[Node]) -> None:
        for n in nodes:
            if n.meaning:
                self.meanings.setdefault((scope, n.name), set()).add(n.meaning)
                self.anywhere.setdefault(n.name, set()).add(n.meaning)
            self.beside.setdefault((scope, n.name), set()).update(x.name for x in nodes if x is not n)

    def cost(self, scope: str):
        def like(x: set[frozenset], y: frozenset) -> float:
            return max((len(a & y) / len(a | y) for a in x), default=0.0)

        def cost(a: Node, b: Node) -> float:
            """Cost of reading declared field ``a`` from the undeclared field ``b`` of a load."""
            if b.name in self.beside.get((scope, a.name), ()) or a.name in self.beside.get((scope, b.name), ()):
                return NEVER
            known = self.meanings.get((scope, b.name))
            sure = False
            if known and a.meaning:
                if like(known, a.meaning) < 0.67:
                    return NEVER
                sure = True
            elif a.meaning and self.anywhere.get(b.name) and like(self.anywhere[b.name], a.meaning) < 0.67:
                return NEVER
            x, y = name_words(a.name), name_words(b.name)
            near = len(x & y) / max(1, len(x | y))
            return 0.3 + (0.0 if sure else 0.4) + 0.4 * (1 - near) + self._unlike(scope, a, b, sure)

        return cost

    def _unlike(self, scope: str, a: Node, b: Node, sure: bool) -> float:
        """How unlike the values of ``b`` here are those of ``a`` elsewhere, 0 to 1 or NEVER."""
        types, forms, words, mid = b.facts
        allowed = JSON_TYPES.get(a.kind)
        usual = self.forms.get((scope, a.name), {})
        if not sum(forms.values()):
            return 0.5
        if usual:
            fit = sum(n for f, n in forms.items() if usual.get(f, 0) >= 0.02) / sum(forms.values())
        else:
            fit = 1.0 if allowed is None or types & allowed else 0.0
        if fit < 0.5:
            return 0.5 if sure else NEVER
        seen = self.words.get((scope, a.name))
        if words and seen and forms.get("w", 0) + forms.get("b", 0) > 0.5 * sum(forms.values()):
            # Booleans and words are told apart: a load may write its booleans as words.
            flags = max((w for w in words if w), key=words.get, default="") in ("true", "false")
            seen = {w: x for w, x in seen.items() if (w in ("true", "false")) == flags}
            words = {w: x for w, x in words.items() if (w in ("true", "false")) == flags}
            n, share = sum(words.values()) or 1.0, sum(seen.values()) or 1.0
            seen = {w: x / share for w, x in seen.items()}
            both = sum(min(k / n, seen.get(w, 0.0)) for w, k in words.items())
            if both < 0.2:
                return 0.5 if sure else NEVER
            return 0.3 * (1 - both)
        span = self.middle.get((scope, a.name))
        if mid is not None and span is not None:
            off = abs(mid - span[1]) / max(span[2] - span[0], 1e-9)
            if off > 0.5:
                return 0.5 if sure else NEVER
            return 0.3 * off
        return 0.0 if fit > 0.9 else 0.2


def usual_keys(stats: DataFrame) -> DataFrame:
    """(scope, field, kind, key, share) of the forms and words with at least 1/200 of a field: at most 200 of each per field."""
    f = ["scope", "field"]
    g = stats.where("kind in ('c', 'w')").groupBy(*f, "kind", "key").agg(F.sum("n").alias("n"))
    size = g.groupBy(*f, "kind").agg(F.sum("n").alias("m"))
    return g.join(size, [*f, "kind"]).where("n >= 0.005 * m").select(*f, "kind", "key", (F.col("n") / F.col("m")).alias("share"))


def load_layouts(stats: DataFrame, usual: DataFrame) -> DataFrame:
    """(scope, job, fields): one row per load, its fields with types, forms, words and middle value.

    Forms and words that are usual in no field of the scope are one entry, '',
    with their sum: only that is asked of them.
    """
    j = ["scope", "job", "field"]
    known = F.broadcast(usual.select("scope", "kind", "key").distinct().withColumn("known", F.lit(True)))
    few = stats.where("kind in ('j', 'c', 'w')").join(known, ["scope", "kind", "key"], "left").withColumn("key", F.when((F.col("kind") == "j") | F.col("known"), F.col("key")).otherwise(""))
    few = few.groupBy(*j, "kind", "key").agg(F.sum("n").alias("n"))
    mid = stats.where("kind in ('n', 'd')").groupBy(*j).agg(F.percentile(F.col("key").cast("double"), F.lit(0.5), F.col("n")).alias("v"))
    rows = few.select(*j, "kind", "key", F.col("n").cast("double").alias("v")).unionByName(mid.select(*j, F.lit("m").alias("kind"), F.lit("").alias("key"), "v"))
    return rows.groupBy("scope", "job").agg(F.collect_list(F.struct("field", "kind", "key", "v")).alias("fields"))


def learn(stats: DataFrame, layouts: DataFrame, usual: DataFrame, declared: dict[str, tuple[str, list[Node]]]) -> Knowledge:
    """Knowledge from all loads; what reaches the driver is bounded by the names in use, not by records or loads."""
    k = Knowledge()
    names: dict[str, set[str]] = {}
    for scope, nodes in declared.values():
        k.declare(scope, nodes)
        names.setdefault(scope, set()).update(n.name for n in nodes)
    # Which names stand beside a name of a load: distinct pairs with a name that no schema of the scope declares.
    known = F.create_map(*[x for s, ns in names.items() for x in (F.lit(s), F.array(*map(F.lit, sorted(ns))))]) if names else None
    fields = layouts.select("scope", F.array_distinct(F.col("fields.field")).alias("f"))
    if known is not None:
        fields = fields.withColumn("odd", F.array_except("f", F.coalesce(known[F.col("scope")], F.array().cast("array<string>"))))
        pairs = fields.where(F.size("odd") > 0).select("scope", "f", F.explode("odd").alias("a")).select("scope", "a", F.explode("f").alias("b")).where("a <> b").distinct()
        for r in pairs.collect():
            k.beside.setdefault((r[0], r[1]), set()).add(r[2])
    f = ["scope", "field"]
    for r in usual.select(*f, "kind", "key", "share").collect():
        (k.forms if r[2] == "c" else k.words).setdefault((r[0], r[1]), {})[r[3]] = r[4]
    num = stats.where("kind in ('n', 'd')").groupBy(*f).agg(F.percentile(F.col("key").cast("double"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), F.col("n")).alias("p"))
    for r in num.collect():
        k.middle[r[0], r[1]] = tuple(r[2])
    return k


def load_changes(records: DataFrame, schemas: DataFrame, id_of_schema: str = "schema_id") -> DataFrame:
    """(scope_id, change_kind, field_name, new_name) between the declared fields of each load's schema and its records.

    ``records`` has job, ``id_of_schema`` and data.  Loads without a readable
    record, of an unknown schema or of one whose fields can't be read have no
    changes.  ``schemas`` has one row per schema version, a table that doesn't
    grow with the data.
    """
    declared = {}
    for r in schemas.select("id", "name", "fields").collect():
        nodes = parse_fields(r[2])
        if nodes is not None and r[0] is not None:
            declared[r[0]] = (r[1] or "", nodes)
    spark = records.sparkSession
    sids = spark.createDataFrame([(k, v[0]) for k, v in declared.items()], f"{id_of_schema} string, scope string")
    rows = records.where("job is not null and data is not null").join(F.broadcast(sids), id_of_schema)
    stats = materialize(field_stats(rows.select(F.col("scope"), F.concat_ws("\x1e", "job", id_of_schema).alias("job"), "data")), "layout-stats")
    usual = materialize(usual_keys(stats), "usual-keys")
    layouts = materialize(load_layouts(stats, usual), "layouts")
    facts = spark.sparkContext.broadcast((declared, learn(stats, layouts, usual, declared)))

    def run(batches):
        for b in batches:
            tree, know = facts.value
            rows = []
            for scope, key, fields in zip(*(b.column(i).to_pylist() for i in range(3))):
                job, sid = key.split("\x1e")
                seen: dict[str, tuple] = {}
                for x in fields:
                    t = seen.setdefault(x["field"], ({}, {}, {}, []))
                    if x["kind"] == "m":
                        t[3].append(x["v"])
                    else:
                        t["jcw".index(x["kind"])][x["key"]] = x["v"]
                old = tree[sid][1]
                kinds = {n.name: n.kind for n in old}
                new = []
                for name, (types, forms, words, mid) in seen.items():
                    full = {t for t in types if t != "null"}
                    ok = JSON_TYPES.get(kinds.get(name, ""))
                    kind = kinds.get(name, "")
                    if name in kinds and full and ok is not None and not full & ok:
                        kind = "?" + ",".join(sorted(full))
                    new.append(Node(name, kind, facts=(full, forms, words, mid[0] if mid else None)))
                flat = [Node(n.name, n.kind, n.meaning) for n in old]
                rows += [(job, *s) for s in edit_script(flat, new, know.cost(scope))[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["scope_id", "change_kind", "field_name", "new_name"])

    return layouts.mapInArrow(run, "scope_id string, " + CHANGE)


#: Words that stand for a boolean.
_TRUE, _FALSE = frozenset(("true", "yes", "1", "y", "t")), frozenset(("false", "no", "0", "n", "f"))


def cast(v, kind: str):
    """A value of another JSON type as the declared ``kind``, or as it is where it can't be read so."""
    if isinstance(v, dict) and len(v) == 1:  # a value in a wrapper of one name
        v = next(iter(v.values()))
    if v is None or isinstance(v, (dict, list)):
        return v
    text = J.scalar(v)
    if kind == "str":
        return text
    if kind in ("int", "float"):
        return J.Num(text.strip()) if re.fullmatch(r"\s*-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\s*", text) else v
    if kind == "bool":
        low = text.strip().lower()
        return True if low in _TRUE else False if low in _FALSE else v
    if kind == "datetime" and type(v) is J.Num and re.fullmatch(r"\d{9,10}", text):
        return dt.datetime.fromtimestamp(int(text), dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return v


class Projection:
    """A script, compiled: how a record of the later layout is read under the earlier one.

    Renames and moves go back to the old path, retyped fields are cast to the
    declared kind; added fields keep their name, removed ones stay absent.
    """

    def __init__(self, script: list[tuple[str, str, str]], kinds: dict[str, str] | None = None):
        self.names: dict[str, str] = {}
        self.casts: dict[str, str] = {}
        self.paths: list[tuple[list[str], list[str]]] = []
        for change, old, new in script:
            above = old.rsplit(".", 1)[0] + "." if "." in old else ""
            if change == "renamed" and not above:
                self.names[new] = old
            elif change == "renamed":
                self.paths.append(((above + new).split("."), old.split(".")))
            elif change == "moved":
                self.paths.append((new.split("."), old.split(".")))
            elif change == "retyped" and kinds and old in kinds:
                self.casts[old] = kinds[old]

    def read(self, record: dict) -> dict:
        out = {self.names.get(k, k): v for k, v in record.items()}
        for source, target in self.paths:
            self._move(out, [self.names.get(source[0], source[0]), *source[1:]], target)
        for name, kind in self.casts.items():
            if name in out:
                out[name] = cast(out[name], kind)
        return out

    @staticmethod
    def _move(out: dict, source: list[str], target: list[str]) -> None:
        at = out
        for k in source[:-1]:
            at = at.get(k)
            if not isinstance(at, dict):
                return
        if source[-1] in at:
            v, to = at.pop(source[-1]), out
            for k in target[:-1]:
                to = to.setdefault(k, {})
                if not isinstance(to, dict):
                    return
            to[target[-1]] = v


def compile_script(script: list[tuple[str, str, str]], kinds: dict[str, str] | None = None) -> Projection:
    """The projection of a script; ``kinds`` are the declared types of the earlier layout."""
    return Projection(script, kinds)


def scripts_of(changes: DataFrame) -> DataFrame:
    """(scope_id, script): the steps that a projection needs, a row per layout; as long as the layout is wide."""
    return changes.where("change_kind in ('renamed', 'retyped', 'moved')").groupBy("scope_id").agg(F.collect_list(F.struct("change_kind", "field_name", "new_name")).alias("script"))


def chains(schemas: DataFrame, changes: DataFrame) -> dict[str, list[Projection]]:
    """Schema id -> projections from its layout back to the first of its workspace and name; the tables of schemas don't grow."""
    step = {r[0]: [tuple(x) for x in r[1]] for r in scripts_of(changes).collect()}
    out: dict[str, list[Projection]] = {}
    last: dict[tuple, list[Projection]] = {}
    for r in schemas.select("workspace_id", "name", "version", "id").orderBy("workspace_id", "name", "version", "id").collect():
        own = [p] if (p := Projection([x for x in step.get(r[3], []) if x[0] != "retyped"])).names or p.paths else []
        out[r[3]] = last[r[0], r[1]] = own + last.get((r[0], r[1]), [])
    return out


def unified(records: DataFrame, schemas: DataFrame, id_of_schema: str = "schema_id", changes: DataFrame | None = None) -> DataFrame:
    """(record_id, job_id, scope, fields): all readable records under one name per field.

    ``fields`` maps the first name a field had in its workspace to the value as
    text, cast to the declared type where the load had another; the scripts of
    the load and of the schema versions are compiled into projections that
    every record passes through.  Unreadable records give no row.
    """
    versions = version_changes(schemas)
    if changes is None:
        changes = load_changes(records, schemas, id_of_schema)
    back = chains(schemas, versions)
    spark = records.sparkSession
    scopes, kinds = {}, {}
    for r in schemas.select("id", "name", "fields").collect():
        scopes[r[0]], kinds[r[0]] = r[1], {n.name: n.kind for n in parse_fields(r[2]) or []}
    facts = spark.sparkContext.broadcast((scopes, kinds, back))
    rows = records.select("id", "job", F.col(id_of_schema).alias("sid"), "data").where("data is not null")
    rows = rows.join(scripts_of(changes).withColumnRenamed("scope_id", "job"), "job", "left").select("id", "job", "sid", "data", "script")
    kind = "array<struct<key:string,value:string>>"

    def run(batches):
        scopes, kinds, back = facts.value
        known: dict[tuple, list[Projection]] = {}
        for b in batches:
            out = [[] for _ in range(4)]
            for rid, job, sid, text, script in zip(*(b.column(i).to_pylist() for i in range(5))):
                d = J.read(text)
                if not isinstance(d, dict):
                    continue
                steps = known.get((job, sid))
                if steps is None:
                    own = compile_script([(x["change_kind"], x["field_name"], x["new_name"]) for x in script or []], kinds.get(sid))
                    steps = known[job, sid] = [own, *back.get(sid, [])]
                for p in steps:
                    d = p.read(d)
                for c, x in zip(out, (rid, job, scopes.get(sid), [(k, J.scalar(v)) for k, v in d.items()])):
                    c.append(x)
            entries = [x for e in out[3] for x in e]
            ends = np.cumsum([0, *map(len, out[3])], dtype=np.int32)
            pairs = pa.StructArray.from_arrays([J.strings([x[0] for x in entries]), J.strings([x[1] for x in entries])], names=["key", "value"])
            yield pa.RecordBatch.from_arrays([J.strings(c) for c in out[:3]] + [pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["record_id", "job_id", "scope", "entries"])

    made = rows.mapInArrow(run, f"record_id string, job_id string, scope string, entries {kind}")
    return made.select("record_id", "job_id", "scope", F.map_from_entries("entries").alias("fields"))
