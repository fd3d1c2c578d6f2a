"""Column-level data quality profile (problem 5).

Two layers, one method: counts kept beside a column chunk come first, its
values only where those don't suffice.

``footer_profile`` profiles the columns of the files themselves: rows, exact
null counts and extrema come from the footers where a chunk has valid
statistics, distinct values from its dictionary where it is encoded by one
throughout, and only chunks whose statistics are insufficient are decoded.

The fields inside the JSON column have no footers, so ``find_violations``
reads the JSON once and lays it out as column chunks with dictionaries
(:func:`fieldstats.column_chunks`).  Null rates, forms, words and ranges come
from the dictionaries alone; they say what a field is like and which loads
stand apart.  Every dictionary entry is then held against the rules of its
field, and positions and ids are read only where an entry breaks them.

A form, word or range that a whole load shares is no finding of its records,
a shifted one is a finding of the load.  What a rule needs before it speaks is
stated as a bound on counts, alike at every size: a load with less than
``LEAST`` values of a field isn't held against others, nor is any where fewer
than three loads (nulls) or five (numbers) have the field.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.paths import locate
from .fieldstats import TOP, column_chunks

#: Share of its values from which a form or word belongs to a field; of a load's values from which the load shares it.
COMMON, SHARED = 0.03, 0.5
#: A word belongs to a field from this share on; the accepted words of a field with a set of words cover this much.
WORD, COVER = 0.01, 0.9
#: A gap in the sorted values beyond the middle 98 %, as a part of their span, that ends the range of a field; wider by GAP * FEW / n for n values.
GAP, FEW = 0.3, 30
#: Share of a form from which the length of its digit runs is fixed, three unseen values granted.
FIXED = 0.94
#: Forms and words with less than this share of a field can't belong to it, and count as absent elsewhere.
RARE = 0.001
#: How far the null rate or the words of a load must lie from the other loads', and how many values it needs.
DEPART, NULLS, LEAST = 0.5, 0.35, 12


# ---- footers ----------------------------------------------------------------

FOOTER = "file string, row_group int, column string, rows bigint, nulls bigint, lo string, hi string, distinct array<string>, source string"


def _open(path: str, **options):
    """A parquet file by path or URI, on the file system the URI names."""
    import pyarrow.parquet as pq

    system, at = locate(path)
    return pq.ParquetFile(at, filesystem=system, **options)


def _text(v) -> str | None:
    return None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def footer_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per file, row group and column of the parquet files behind ``df``.

    ``source`` says where each row's figures come from: ``footer`` (nulls and
    extrema), ``footer+dictionary`` (distinct values too) or ``scan``.
    Extrema of text may be cut by the writer; such a chunk counts as
    insufficient and is scanned.  An empty table has rows of zeros or none.
    """
    spark = df.sparkSession
    want = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() in PROFILED]
    files = spark.createDataFrame([(f,) for f in df.inputFiles()], "file string")
    files = files.repartition(max(1, min(len(df.inputFiles()), 10_000)), "file")

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                f = _open(path)
                meta = f.metadata
                out: list[list] = [[] for _ in range(9)]
                index = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    rg = meta.row_group(g)
                    for c in want:
                        if c not in index:
                            continue
                        col = rg.column(index[c])
                        st = col.statistics
                        exact = st is not None and st.has_null_count and (st.has_min_max or st.null_count == rg.num_rows)
                        if exact and st.has_min_max:
                            exact = getattr(st, "is_min_value_exact", None) is not False and getattr(st, "is_max_value_exact", None) is not False
                            if col.physical_type == "BYTE_ARRAY" and max(len(str(st.min)), len(str(st.max))) >= 64:
                                exact = False
                        coded = col.has_dictionary_page and all(e in ("PLAIN", "RLE", "RLE_DICTIONARY", "PLAIN_DICTIONARY", "BIT_PACKED") for e in col.encodings) and col.encodings.count("PLAIN") <= 1
                        distinct, source = None, "footer"
                        if exact:
                            nulls, lo, hi = st.null_count, (st.min if st.has_min_max else None), (st.max if st.has_min_max else None)
                        if not exact or (coded and col.physical_type == "BYTE_ARRAY"):
                            read = _open(path, read_dictionary=[c])
                            arr = read.read_row_group(g, columns=[c]).column(0)
                            chunk = arr.combine_chunks()
                            if isinstance(chunk, pa.ChunkedArray):
                                chunk = chunk.chunk(0) if chunk.num_chunks else pa.array([], chunk.type)
                            values = chunk.dictionary if pa.types.is_dictionary(chunk.type) else pc.unique(chunk)
                            values = values.drop_null() if hasattr(values, "drop_null") else values
                            if len(values) <= 1000:
                                distinct = sorted(map(_text, values.to_pylist()))
                            source = "footer+dictionary" if exact else "scan"
                            if not exact:
                                nulls = chunk.null_count
                                mm = pc.min_max(values)
                                lo, hi = mm["min"].as_py(), mm["max"].as_py()
                        for x, v in zip(out, (path, g, c, rg.num_rows, nulls, _text(lo), _text(hi), distinct, source)):
                            x.append(v)
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=[x.split()[0] for x in FOOTER.split(", ")])

    return files.mapInArrow(run, FOOTER)


#: Types that :func:`footer_profile` has figures for.
PROFILED = ("string", "int", "bigint", "double", "float", "boolean", "timestamp_ntz", "timestamp", "date")


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, column_type, n_rows, n_nulls, distinct_values, min_value, max_value) of every column of a type in ``PROFILED``.

    Nulls and extrema come from the footers; extrema are compared in the
    column's own type and written as its text.  ``distinct_values`` counts
    distinct values: from dictionaries where every chunk has one of at most a
    thousand entries, from a scan of the column otherwise.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.dataType.simpleString() in PROFILED}
    chunks = materialize(footer_profile(df, list(types)), "footers")
    base = chunks.groupBy("column").agg(F.sum("rows").alias("n_rows"), F.sum("nulls").alias("n_nulls"), F.count_if(F.col("distinct").isNull() & (F.col("nulls") < F.col("rows"))).alias("open"))
    ends = [chunks.where(F.col("column").isin([c for c in types if types[c] == t])).groupBy("column").agg(F.lit(t).alias("column_type"), F.min(F.col("lo").cast(t)).cast("string").alias("min_value"), F.max(F.col("hi").cast(t)).cast("string").alias("max_value")) for t in dict.fromkeys(types.values())]
    for e in ends[1:]:
        ends[0] = ends[0].unionByName(e)
    coded = chunks.where("distinct is not null").select("column", F.explode("distinct").alias("v")).distinct().groupBy("column").agg(F.count("*").alias("d"))
    out = base.join(ends[0], "column").join(coded, "column", "left")
    need = [r[0] for r in base.where("open > 0").select("column").collect()]  # column names of one table
    if need:
        text = lambda c: (F.col(c) + 0.0 if types[c] in ("double", "float") else F.col(c)).cast("string")  # noqa: E731  # -0.0 is 0.0
        # Digests of 128 bits stand for the values, so long texts aren't shuffled.
        scan = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.unhex(F.md5(text(c))).alias("v")) for c in need])).alias("x")).select("x.*").where("v is not null")
        out = out.join(scan.distinct().groupBy("column").agg(F.count("*").alias("s")), "column", "left")
    else:
        out = out.withColumn("s", F.lit(None).cast("bigint"))
    return out.select(F.lit(table).alias("table_name"), F.col("column").alias("column_name"), "column_type", "n_rows", "n_nulls", F.coalesce("s", "d", F.lit(0)).alias("distinct_values"), "min_value", "max_value")


# ---- what a field is like ------------------------------------------------------


class Rules:
    """Accepted forms, words and ranges of every field, from counts over all loads.

    ``forms`` maps a field to {(form, digits): n}, ``words`` to {word: n},
    ``numbers`` a field and kind to {number: n}.
    """

    def __init__(self, forms: dict, words: dict, numbers: dict):
        self.forms, self.digits, self.words, self.ranges = {}, {}, {}, {}
        for f, c in forms.items():
            n, base = sum(c.values()), {}
            for (form, _), k in c.items():
                base[form] = base.get(form, 0) + k
            self.forms[f] = [x for x, k in base.items() if k >= COMMON * n]
            # The number of digits counts where it is one and the same almost everywhere.
            self.digits[f] = {}
            for form in self.forms[f]:
                k, digits = max((k, d) for (x, d), k in c.items() if x == form)
                if k >= FIXED * (base[form] + 3):
                    self.digits[f][form] = digits
        # A word that occurs once belongs to a field only if it is usual in another.
        vocabulary = {w for c in words.values() for w, k in c.items() if k >= max(2, WORD * sum(c.values()))}
        for f, c in words.items():
            n = sum(c.values())
            ok = [w for w, k in c.items() if k >= WORD * n and w in vocabulary]
            if ok and sum(c[w] for w in ok) >= COVER * n:
                self.words[f] = ok
        for (f, kind), c in numbers.items():
            self.ranges[f, kind] = _range(sorted((float(k), n) for k, n in c.items()))

    def rows(self) -> list[tuple]:
        """One row per field for :data:`RULES`."""
        none = (None, None, None)
        return [(*f, self.forms[f], self.digits[f], self.words.get(f), self.ranges.get((f, "n"), none), self.ranges.get((f, "d"), none)) for f in self.forms]


_SPAN = "struct<lo:double,hi:double,whole:boolean>"
RULES = f"scope string, field string, forms array<string>, fixed map<string,string>, words array<string>, n_range {_SPAN}, d_range {_SPAN}"


def broken() -> Column:
    """What an entry (form, digits, kind, key) breaks of the rules of its field: form ``c``, its digits ``g``, word ``w``, range ``n`` or ``d``; null if nothing."""
    x = F.col("key").cast("double")

    def outside(span: str, whole: bool) -> Column:
        out = F.col(f"{span}.lo").isNull() | (x < F.col(f"{span}.lo")) | (x > F.col(f"{span}.hi"))
        return out | (F.col(f"{span}.whole") & (x != F.floor(x))) if whole else out

    fixed = F.try_element_at("fixed", F.col("form"))
    rules = F.when(~F.array_contains("forms", F.col("form")), "c").when(fixed != F.col("digits"), "g")
    rules = rules.when((F.col("kind") == "w") & ~F.array_contains("words", F.col("key")), "w")
    rules = rules.when((F.col("kind") == "n") & outside("n_range", True), "n").when((F.col("kind") == "d") & outside("d_range", False), "d")
    return F.when(~F.col("kind").isin("z", TOP), rules)


def _quantile(points, q: float) -> float:
    total, seen = sum(n for _, n in points), 0
    for x, n in points:
        seen += n
        if seen >= q * total:
            return x
    return points[-1][0]


def _range(points) -> tuple[float, float, bool]:
    """(low, high, whole numbers) that hold the values up to the first plain gap beyond the middle 98 %."""
    total = sum(n for _, n in points)
    lo, hi = _quantile(points, 0.01), _quantile(points, 0.99)
    if sum(n for x, n in points if x < 0) <= 0.02 * total and lo < 0:
        lo = min(x for x, _ in points if x >= 0)
    gap = GAP * (1 + FEW / total) * max(hi - lo, abs(hi) / 32, 1e-9)
    for x, _ in points:
        if x > hi:
            if x - hi > gap:
                break
            hi = x
    for x, _ in reversed(points):
        if x < lo:
            if lo - x > gap or x < 0 <= lo and sum(n for y, n in points if y < 0) <= 0.02 * total:
                break
            lo = x
    whole = sum(n for x, n in points if x != int(x)) <= 0.02 * total
    return lo - abs(lo) / 32, hi + abs(hi) / 32, whole and all(abs(x) < 2**20 for x in (lo, hi))


def _whole() -> Column:
    """A form with its digits."""
    return F.concat_ws("\n", "form", "digits")


LOAD, FIELD = ["scope", "job", "field"], ["scope", "field"]


def _some(c: Column, value: Column) -> Column:
    return F.sum(F.when(c, value).otherwise(0))


def load_profile(stats: DataFrame) -> DataFrame:
    """One row per load and field: values and nulls, the commonest value's number, numbers of words and booleans, quartiles of numbers (``n``) and days (``d``)."""
    n, kind, flag = F.col("n"), F.col("kind"), F.col("key").isin("true", "false")
    out = [_some(kind != TOP, n).alias("m"), F.coalesce(F.max(F.when(kind == TOP, n)), F.lit(0)).alias("top"), _some(kind == "z", n).alias("z"), _some((kind == "w") & ~flag, n).alias("words"), _some((kind == "w") & flag, n).alias("flags")]
    for k in "nd":
        out += [_some(kind == k, n).alias(f"m_{k}"), F.percentile(F.when(kind == k, F.col("key").cast("double")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n).alias(f"q_{k}")]
    return stats.groupBy(*LOAD).agg(*out)


def field_facts(loads: DataFrame, numbers: dict) -> DataFrame:
    """What the loads of a field have in common, a row per field: null counts, the usual share of the commonest value, and centre, spread and span of numbers and days."""
    mids = [F.count("*").alias("jobs"), F.sum("m").alias("all_m"), F.sum("z").alias("all_z"), F.sum("words").alias("all_words"), F.sum("flags").alias("all_flags")]
    full = F.col("m") - F.col("z") >= LEAST
    mids += [F.percentile(F.when(full, F.col("top") / (F.col("m") - F.col("z"))), F.lit(0.5)).alias("mid_top"), F.count_if(full).alias("jobs_full")]
    for k in "nd":
        enough = F.col(f"m_{k}") >= LEAST
        mids += [F.percentile(F.when(enough, F.col(f"q_{k}")[1]), F.lit(0.5)).alias(f"mid_{k}"), F.percentile(F.when(enough, F.col(f"q_{k}")[2] - F.col(f"q_{k}")[0]), F.lit(0.5)).alias(f"iqr_{k}"), F.count_if(enough).alias(f"jobs_{k}")]
    spark = loads.sparkSession
    # One row per name in use.
    mid = loads.groupBy(*FIELD).agg(*mids)
    mid = spark.createDataFrame(mid.collect(), mid.schema)
    dev = [F.percentile(F.when(F.col(f"m_{k}") >= LEAST, F.abs(F.col(f"q_{k}")[1] - F.col(f"mid_{k}"))), F.lit(0.5)).alias(f"mad_{k}") for k in "nd"]
    mad = {(r[0], r[1]): r for r in loads.join(F.broadcast(mid), FIELD).groupBy(*FIELD).agg(*dev).collect()}
    rows = []
    for r in mid.collect():
        f = (r["scope"], r["field"])
        spans = []
        for k in "nd":
            points = sorted((float(x), n) for x, n in numbers.get((f, k), {}).items())
            spans.append(_quantile(points, 0.98) - _quantile(points, 0.02) if points else None)
        rows.append((*r, mad[f]["mad_n"], mad[f]["mad_d"], *spans))
    return spark.createDataFrame(rows, mid.schema.add("mad_n", "double").add("mad_d", "double").add("span_n", "double").add("span_d", "double"))


def judged_loads(loads: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, job, field, m, z, words, flags, nulls, same, moved_n, moved_d): whether the null rate of a load, the share of one value, the numbers or the days depart from the other loads'."""
    rest = F.col("all_m") - F.col("m")
    off = F.abs(F.col("z") / F.col("m") - (F.col("all_z") - F.col("z")) / rest) > NULLS
    flags = [((F.col("jobs") > 2) & (F.col("m") >= LEAST) & (rest > 0) & off).alias("nulls")]
    full = F.col("m") - F.col("z")
    flags.append(((F.col("jobs_full") > 4) & (full >= LEAST) & (F.col("top") > (F.col("mid_top") + DEPART) * full)).alias("top"))
    for k in "nd":
        dev = F.abs(F.col(f"q_{k}")[1] - F.col(f"mid_{k}"))
        flags.append(((F.col(f"jobs_{k}") > 4) & (F.col(f"m_{k}") >= LEAST) & (dev > 9 * F.col(f"mad_{k}")) & (dev > 0.25 * F.col(f"span_{k}")) & (dev > F.col(f"iqr_{k}"))).alias(k))
    return loads.join(F.broadcast(facts), FIELD).select(*LOAD, "m", "z", "words", "flags", *[F.coalesce(x, F.lit(False)).alias(n) for x, n in zip(flags, ("nulls", "same", "moved_n", "moved_d"))])


def shifted_words(stats: DataFrame, loads: DataFrame, words: dict, spark) -> DataFrame:
    """(job, field) whose words, or whose booleans, have shares that depart from those elsewhere."""
    rows = []
    for (scope, field), c in words.items():
        for flag in (False, True):
            own = {w: n for w, n in c.items() if (w in ("true", "false")) == flag}
            rows += [(scope, field, w, n, max(own.values())) for w, n in own.items()]
    # At most 1 / RARE words per field.
    usual = F.broadcast(spark.createDataFrame(rows, "scope string, field string, key string, all_n bigint, top bigint"))
    flag = F.col("key").isin("true", "false")
    w = stats.where("kind = 'w'").groupBy(*LOAD, "key").agg(F.sum("n").alias("n")).join(usual, [*FIELD, "key"], "left")
    w = w.join(loads, LOAD).withColumn("m", F.when(flag, F.col("flags")).otherwise(F.col("words"))).withColumn("all_m", F.when(flag, F.col("all_flags")).otherwise(F.col("all_words")))
    w = w.where((F.col("m") >= LEAST) & (F.col("all_m") > 2 * F.col("m")))
    elsewhere = F.greatest(F.lit(0), F.coalesce("all_n", F.lit(0)) - F.col("n")) / (F.col("all_m") - F.col("m"))
    w = w.groupBy("job", "field", flag.alias("flag")).agg(F.sum(F.greatest(F.lit(0.0), F.col("n") / F.col("m") - elsewhere)).alias("far"), F.max(F.col("top") / F.col("all_m")).alias("top"))
    return w.where((F.col("far") > DEPART) & (F.col("top") > 0.05)).select("job", "field")


def find_violations(records: DataFrame, id_col: str = "id") -> DataFrame:
    """(job_id, record_id, field_name) from records (scope, job, id, data).

    ``scope`` is what shares one layout (a schema's name), ``job`` the load.
    record_id is '' for a finding of the whole load.  Null values, unreadable
    records and those of a null scope or job have no findings; equal records
    have them under each id.
    """
    spark = records.sparkSession
    rows = records.where("scope is not null and job is not null and data is not null").select("scope", "job", F.col(id_col).cast("string").alias("id"), "data")
    chunks = materialize(column_chunks(rows), "field-chunks")
    cells = chunks.select("scope", "job", F.explode("cols").alias("c")).select("scope", "job", "c.field", F.explode("c.dict").alias("e"))
    entry = ["form", "digits", "kind", "key"]
    stats = materialize(cells.groupBy(*LOAD, *[F.col(f"e.{x}").alias(x) for x in entry]).agg(F.sum("e.n").alias("n")), "field-stats")
    loads = materialize(load_profile(stats), "field-loads")

    # What reaches the driver is bounded by the names in use: forms and words of a share, bins of numbers (64 per power of two), days.
    size = F.broadcast(loads.groupBy(*FIELD).agg(F.sum(F.col("m") - F.col("z")).alias("all")))
    asked = F.array(F.struct(F.lit("c").alias("k"), F.col("form").alias("a"), F.col("digits").alias("b")), F.struct(F.col("kind").alias("k"), F.col("key").alias("a"), F.lit("").alias("b")))
    values = ~F.col("kind").isin("z", TOP)
    counts = stats.where(values).select(*LOAD, F.explode(asked).alias("x"), "n").where("x.k <> ''")
    total = counts.groupBy(*FIELD, "x").agg(F.sum("n").alias("n")).join(size, FIELD).where(F.col("x.k").isin("n", "d") | (F.col("n") >= RARE * F.col("all")))
    forms: dict = {}
    words: dict = {}
    numbers: dict = {}
    for sc, f, (k, a, b), n in total.select(*FIELD, "x", "n").collect():
        if k == "c":
            forms.setdefault((sc, f), {})[a, b] = n
        elif k == "w":
            words.setdefault((sc, f), {})[a] = n
        else:
            numbers.setdefault(((sc, f), k), {})[a] = n
    facts = field_facts(loads, numbers)
    judged = materialize(judged_loads(loads, facts), "field-judged")
    # Loads that have moved don't widen a range.
    moved = judged.where("moved_n or moved_d").select(*LOAD, F.array_compact(F.array(F.when(F.col("moved_n"), "n"), F.when(F.col("moved_d"), "d"))).alias("kinds"))
    gone = counts.where("x.k in ('n', 'd')").join(moved, LOAD).where(F.array_contains("kinds", F.col("x.k"))).groupBy(*FIELD, "x").agg(F.sum("n").alias("n"))
    for sc, f, (k, a, _), n in gone.collect():
        numbers[(sc, f), k][a] -= n
    numbers = {f: kept for f, c in numbers.items() if (kept := {x: n for x, n in c.items() if n > 0})}
    rules = F.broadcast(spark.createDataFrame(Rules(forms, words, numbers).rows(), RULES))

    # Positions and ids are looked up only under entries that break a rule.
    bad = chunks.select("scope", "job", "ids", F.explode("cols").alias("c")).select("scope", "job", "ids", "c.field", F.explode("c.dict").alias("e"))
    bad = bad.select("scope", "job", "field", "ids", *[F.col(f"e.{x}").alias(x) for x in entry], "e.at").join(rules, FIELD).withColumn("broken", broken()).where("broken is not null")
    whole = _whole().alias("whole")
    bad = bad.select("job", "field", "form", whole, "key", "broken", F.explode("at").alias("i"), "ids").select("job", "field", "form", "whole", "key", "broken", F.get("ids", F.col("i")).alias("record_id"))

    # What a load shares: a form, with and without its digits, of at least half of its values, a word of a fifth; so at most nine.
    shared = stats.where(values).select(*LOAD, F.explode(F.array(F.struct(F.lit("c").alias("k"), F.col("form").alias("a")), F.struct(F.lit("g").alias("k"), _whole().alias("a")), F.struct(F.col("kind").alias("k"), F.col("key").alias("a")))).alias("x"), "n").where("x.k in ('c', 'g', 'w')")
    shared = shared.groupBy(*LOAD, "x").agg(F.sum("n").alias("n")).join(judged, LOAD).where((F.col("m") - F.col("z") >= LEAST) & (F.col("n") >= F.when(F.col("x.k") == "w", 0.2).otherwise(SHARED) * (F.col("m") - F.col("z"))))
    shared = shared.select(*LOAD, "x.k", "x.a").unionByName(moved.select(*LOAD, F.explode("kinds").alias("k"), F.lit("").alias("a")))
    shared = shared.groupBy("job", "field").agg(*[F.collect_set(F.when(F.col("k") == k, F.col("a"))).alias(f"own_{k}") for k in "cgwnd"])
    bad = bad.join(shared, ["job", "field"], "left")
    own = lambda k, x: F.coalesce(F.array_contains(f"own_{k}", x), F.lit(False))
    # A word in a load of words: the form is the load's, so the word itself is looked at.
    form = ~own("c", F.col("form")) | ((F.col("form") == "w") & ~own("w", F.col("key")))
    stays = F.when(F.col("broken") == "c", form).when(F.col("broken") == "g", ~own("g", F.col("whole"))).when(F.col("broken") == "w", ~own("w", F.col("key")))
    for k in "nd":
        stays = stays.when(F.col("broken") == k, ~own(k, F.lit("")))
    found = bad.where(stays).select("job", "record_id", "field")
    apart = judged.where("nulls or same or moved_n or moved_d").select("job", "field")
    if words:
        sizes = judged.join(F.broadcast(facts.select(*FIELD, "all_words", "all_flags")), FIELD).select(*LOAD, "words", "flags", "all_words", "all_flags")
        apart = apart.unionByName(shifted_words(stats, sizes, words, spark)).distinct()
    out = found.unionByName(apart.select("job", F.lit("").alias("record_id"), "field"))
    return out.select(F.col("job").alias("job_id"), "record_id", F.col("field").alias("field_name"))


def malformed_names(jobs: DataFrame, id_col: str = "id", name_col: str = "file_name", share: float = 0.05) -> DataFrame:
    """(job_id) of loads whose file name isn't formed like the others.

    The form is the name with the layout's own name replaced, letters and
    digits by runs, digits with their number; an eight-digit date must be a
    real one.  Null names have no finding.
    """
    n = F.col(name_col)
    form = F.when(F.col("scope").isNotNull() & n.startswith(F.col("scope")), F.concat(F.lit("{}"), F.expr(f"substring({name_col}, length(scope) + 1)"))).otherwise(n)
    stem = F.regexp_replace(form, r"\.[a-z0-9]{1,5}$", "")
    for k in (8, 4, 2):
        stem = F.regexp_replace(stem, rf"(?<!\d)\d{{{k}}}(?!\d)", f"<{'d' * k}>")
    ext = F.regexp_extract(form, r"\.([a-z0-9]{1,5})$", 1)
    date = F.regexp_extract(n, r"(?<!\d)(\d{8})(?!\d)", 1)
    real = (date == "") | F.try_to_timestamp(date, F.lit("yyyyMMdd")).isNotNull()
    named = jobs.where(n.isNotNull()).select(F.col(id_col).alias("job_id"), stem.alias("stem"), ext.alias("ext"), real.alias("real"))
    least = share * named.count()
    # At most 1 / share forms and endings are common.
    stems, exts = ([r[0] for r in named.groupBy(c).count().where(F.col("count") >= least).select(c).collect()] for c in ("stem", "ext"))
    return named.where(~(F.col("real") & F.col("stem").isin(stems) & F.col("ext").isin(exts))).select("job_id").distinct()
