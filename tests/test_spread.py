"""Sources that come out of one partition are parsed by all cores, to the same facts."""

import pytest
from pyspark.sql import functions as F

from gatecrest.operators import resolve
from gatecrest.operators.checkpoints import cut
from gatecrest.sources import files
from gatecrest.sources.python_facts import python_facts
from gatecrest.sources.script_facts import script_facts

N = 40_000
SOURCE = {"py": "from m{k} import go\ndef use{k}(p):\n    go(p)\n", "ts": "import {{ go }} from './m{k}';\nexport function use{k}(p) {{ go(p); }}\n"}


def sources(spark, suffix, parts):
    at = F.col("id").cast("string")
    text = F.replace(F.replace(F.replace(F.lit(SOURCE[suffix]), F.lit("{k}"), at), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    return files.from_table(spark.range(0, N, 1, parts).select(F.lit("p").alias("project"), F.concat(F.lit("t/s"), at, F.lit(f".{suffix}")).alias("file"), text.alias("source")))


@pytest.mark.parametrize("suffix,facts_of", [("py", python_facts), ("ts", script_facts)])
def test_one_partition_is_spread(spark, suffix, facts_of):
    facts = cut(facts_of(cut(sources(spark, suffix, 1))))
    sizes = [r.n for r in facts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == N and len(sizes) >= 4  # the cores of the tests
    assert max(sizes) < 2 * N / len(sizes)
    names = resolve.names_of(facts)
    assert names.rdd.getNumPartitions() <= facts.rdd.getNumPartitions()
    one = facts_of(sources(spark, suffix, 1).where("file in ('t/s0." + suffix + "', 't/s39999." + suffix + "')")).collect()
    assert len(one) == 2 and sorted(map(str, one)) == sorted(map(str, facts.where(F.col("file").isin([r.file for r in one])).collect()))


def test_what_is_spread_stays(spark):
    even = sources(spark, "py", 8)
    assert files.spread(even).rdd.getNumPartitions() == 8
    few = sources(spark, "py", 1).limit(300)
    assert files.spread(few).rdd.getNumPartitions() == few.rdd.getNumPartitions()
    none = sources(spark, "py", 1).where("false")
    assert files.spread(none).count() == 0 and python_facts(none).count() == 0


def test_tasks_grow_with_the_input():
    assert files.parts_for(0, 0, 12) == 1 and files.parts_for(100, 10_000, 12) == 1
    assert files.parts_for(60_000, 9 << 20, 12) == 9 and files.parts_for(360_000, 60 << 20, 12) == 24
    assert files.parts_for(10, 3 << 20, 12) == 3  # large files too
    assert files.parts_for(1 << 24, 1 << 34, 12) == 1024  # what a task holds is bounded
