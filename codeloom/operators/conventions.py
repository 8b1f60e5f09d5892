"""Naming and layout conventions of a code index, and metric steps that do not hold each other up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.exprs import confidence, is_exported, is_test_file
from codeloom.literals import literal_rows

#: The patterns that the detectors report.
ERROR, NO_ERROR = "New* constructors return (T, error)", "New* constructors return T (no error)"
SINGLE, DESCRIPTIVE = "single-letter receivers", "descriptive receivers"
COLOCATED, SEPARATE = "colocated test files", "separate test directory"
SUFFIX, NOUN = "-er/-or suffix naming", "noun-based naming"
SENTINEL, INLINE, BOTH = "sentinel errors", "inline error returns", "mixed: sentinel errors + inline returns"
ONE, MANY, MIXED = "one type per file", "multiple types per file", "mixed (no dominant pattern)"


def detected(symbols: DataFrame) -> DataFrame:
    """``convention, pattern, confidence, total, first, second, measure``: a row for each of six conventions of which
    there is a sample. ``first`` and ``second`` count the two forms; ``measure`` is the percentage of pointer receivers,
    the number of helpers in tests, or the mean number of types in a file, else null. Names are compared as they
    are written. One pass over the symbols counts all but what goes by file."""
    name, kind, sig, receiver = (F.coalesce(c, F.lit("")) for c in ("name", "kind", "signature", "receiver"))
    test, one, none = is_test_file(F.col("file_path")), F.lit(1), F.lit(0)
    count = lambda rule: F.sum(F.when(rule, one).otherwise(none)).cast("long")
    made = (kind == "func") & name.startswith("New") & F.col("signature").isNotNull()
    held = (kind == "method") & (receiver != "")
    bare = F.regexp_replace(F.regexp_replace(receiver, r"^[()]+|[()]+$", ""), r"^\*", "")
    shown, low = (kind == "interface") & is_exported(name), F.lower(name)
    fails = (kind == "func") & (sig.endswith("error)") | sig.endswith(" error")) & ~test
    counts = symbols.agg(
        count(made & sig.endswith("error)")).alias("c1"), count(made & ~sig.endswith("error)")).alias("c2"), count(held & (F.char_length(bare) == 1)).alias("r1"), count(held & (F.char_length(bare) != 1)).alias("r2"),
        count(held & receiver.contains("*")).alias("rp"), count(shown & (low.endswith("er") | low.endswith("or"))).alias("i1"), count(shown & ~(low.endswith("er") | low.endswith("or"))).alias("i2"),
        count((kind == "var") & name.startswith("Err")).alias("e1"), count(fails).alias("e2"), count(test & (kind == "func") & name.rlike("^[a-z]")).alias("helpers"),
    )

    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    files = symbols.filter(F.col("file_path").endswith(".go")).groupBy("file_path").agg(F.sum(F.when(kind.isin("struct", "interface", "type"), one).otherwise(none)).cast("long").alias("types"))
    files = files.select(folder.alias("dir"), "types", is_test_file(F.col("file_path")).alias("test"))
    dirs = files.groupBy("dir").agg(count(F.col("test")).alias("tests"), F.bool_or(~F.col("test")).alias("source"))
    layout = dirs.agg(count(F.lit(False)).alias("_"), F.sum(F.when(F.col("source"), F.col("tests")).otherwise(none)).cast("long").alias("t1"), F.sum(F.when(F.col("source"), none).otherwise(F.col("tests"))).cast("long").alias("t2")).drop("_")
    typed = files.filter("not test and types > 0")
    shapes = typed.agg(count(F.col("types") == 1).alias("f1"), count(F.col("types") > 1).alias("f2"), F.sum("types").alias("ft"))
    row = counts.join(layout).join(shapes).na.fill(0)  # three tables of one row

    def convention(label: str, first: str, second: str, pattern: Column, share: Column | None = None, measure: Column | None = None) -> Column:
        a, b = F.col(first), F.col(second)
        ratio = share if share is not None else F.greatest(a, b) / F.nullif(a + b, none.cast("long"))
        parts = {"convention": F.lit(label), "pattern": pattern, "confidence": confidence(ratio, a + b), "total": a + b, "first": a, "second": b, "measure": (F.lit(None) if measure is None else measure).cast("double")}
        return F.when(a + b > 0, F.struct(*(v.alias(k) for k, v in parts.items())))

    either = lambda a, b, x, y: F.when(F.col(b) > F.col(a), y).otherwise(x)
    some = lambda a, b: F.nullif(F.col(a) + F.col(b), none.cast("long"))
    sentinels, major = F.col("e1") / some("e1", "e2"), F.greatest("f1", "f2") / some("f1", "f2")
    found = F.array(
        convention("constructors", "c1", "c2", either("c1", "c2", ERROR, NO_ERROR)),
        convention("receivers", "r1", "r2", either("r1", "r2", SINGLE, DESCRIPTIVE), measure=F.round(1000 * F.col("rp") / some("r1", "r2")) / 10),
        convention("testing", "t1", "t2", either("t1", "t2", COLOCATED, SEPARATE), measure=F.col("helpers")),
        convention("interfaces", "i1", "i2", either("i1", "i2", SUFFIX, NOUN)),
        convention("errors", "e1", "e2", F.when(sentinels > 0.5, SENTINEL).when(F.col("e1") >= 1, BOTH).otherwise(INLINE), share=F.greatest(sentinels, 1 - sentinels)),
        convention("file_org", "f1", "f2", F.when((major >= 0.7) & (F.col("f1") > F.col("f2")), ONE).when((major >= 0.7) & (F.col("f2") > F.col("f1")), MANY).otherwise(MIXED), measure=F.round(10 * F.col("ft") / some("f1", "f2")) / 10),
    )
    return row.select(F.explode(F.array_compact(found)).alias("c")).select("c.*")


Step = tuple[str, Callable[[dict[str, DataFrame]], DataFrame], tuple[str, ...]]


def run_steps(spark: SparkSession, root: str, steps: list[Step]) -> DataFrame:
    """Runs ``(name, make, needs)`` one after the other and commits each one's table to a store on its own, so what is
    written stays whatever comes after. ``make`` takes the tables of the store. A step that fails leaves the store's
    table of its name as it was; a step whose needs were not written in this run is passed. Gives ``name, status, error``
    (``ok``, ``failed``, ``skipped``), which the store keeps as ``steps``."""
    from codeloom.sources import snapshots

    status: list[tuple[str, str, str | None]] = []
    done: set[str] = set()
    for name, make, needs in steps:
        missing = [n for n in needs if n not in done]
        if missing:
            status.append((name, "skipped", f"needs {', '.join(missing)}"))
            continue
        try:
            snapshots.commit(spark, root, {name: make(snapshots.snapshot(spark, root))})
        except Exception as e:  # what went wrong stands in the status; the other steps go on
            status.append((name, "failed", str(e).split("\n")[0][:200]))
        else:
            done.add(name)
            status.append((name, "ok", None))
    out = literal_rows(spark, status, "name string, status string, error string")
    snapshots.commit(spark, root, {"steps": out})
    return snapshots.snapshot(spark, root)["steps"]
