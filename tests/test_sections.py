import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sections

BASE = "intro text here\n## Install\nrun npm install foo\n### macOS\nbrew install foo\n## Usage\ncall foo() to start\n## Advanced\ndeep config here"


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, markdown string")


def split(spark, *texts):
    return sections.split_sections(rows(spark, *texts), "id")


def test_split(spark):
    got = {(r.id, r.pos): (r.heading, r.level, r.body) for r in split(spark, BASE, "", None, "# A\r\nx", "\n\n# T\nb", "# X\n##no\n# \nz", "####### seven\n# nb").collect()}
    assert got[0, 0] == ("(intro)", 0, "intro text here\n") and got[0, 2] == ("macOS", 3, "### macOS\nbrew install foo\n")
    assert got[1, 0] == ("(intro)", 0, "\n") and not [k for k in got if k[0] == 2]
    assert got[3, 0] == ("(intro)", 0, "# A\r\nx\n")  # a line that ends in CR is no heading
    assert got[4, 0] == ("T", 1, "# T\nb\n") and (4, 1) not in got
    assert got[5, 0][0] == "X" and got[5, 1] == ("", 1, "# \nz\n")
    assert got[6, 0][0] == "(intro)" and got[6, 1][:2] == ("nb", 1)


def test_split_gives_back_the_text(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["# a", "## b c", "x", "", "  ", "#no", "text"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    joined = split(spark, *texts).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "").alias("t")).collect()
    got = {r.id: r.t for r in joined}
    assert all((t + "\n").endswith(got[i]) and not (t + "\n")[: len(t) + 1 - len(got[i])].strip() for i, t in enumerate(texts))


@pytest.mark.parametrize("query, body", [("install", "## Install\nrun npm install foo\n### macOS\nbrew install foo"), ("ADVANCED ", "## Advanced\ndeep config here"), ("mac", "### macOS\nbrew install foo"), ("nothing", None)])
def test_find(spark, query, body):
    array = sections.section_array("markdown")
    got = rows(spark, BASE).select(sections.find_section(array, query), sections.find_section(array, query, with_intro=False)).first()
    assert tuple(got) == (body, body)


def test_find_intro_and_nulls(spark):
    array = sections.section_array("markdown")
    got = rows(spark, BASE, None, "").select(sections.find_section(array, "intro"), sections.find_section(array, "intro", with_intro=False)).collect()
    assert [tuple(r) for r in got] == [(BASE, None), (None, None), ("", None)]
    index = spark.createDataFrame([(1, None), (2, []), (3, [(None, 1, None, None, None), ("B", 1, "# B\n", None, None)])], "id long, sections array<struct<heading:string,level:int,body:string,sha256:string,tokens:long>>")
    assert [r[0] for r in index.select(sections.find_section(F.col("sections"), "b")).collect()] == [None, None, "# B"]


def test_outline_and_index(spark):
    text = sections.outline_text(split(spark, BASE), "id").first().outline
    assert text.split("\n")[1] == "    - macOS  (~7 tok)" and len(text.split("\n")) == 4
    many, huge = "\n".join(f"## H{i}\nbody {i}" for i in range(60)), "## Big\n" + "x" * 700_000
    got = {r.id: r.n for r in sections.build_index(rows(spark, BASE, many, huge), "id").select("id", F.size("sections").alias("n")).collect()}
    assert got == {0: 5, 1: None, 2: None}


def changes(spark, before, after):
    old = sections.split_sections(rows(spark, before), "id")
    new = sections.split_sections(rows(spark, after), "id")
    return sections.diff_indexes(old, new, "id")


def test_diff(spark):
    edited = BASE.replace("call foo() to start", "call foo(opts) to begin")
    diff = changes(spark, BASE, edited)
    assert [(r.heading, r.change) for r in diff.filter("change != 'same'").collect()] == [("Usage", "changed")]
    assert tuple(sections.delta_counts(diff, "id").first())[1:] == (1, 0, 0, 4, 5)
    longer = BASE + "\n## Troubleshooting\nturn it off"
    assert [r.heading for r in changes(spark, BASE, longer).filter("change = 'added'").collect()] == ["Troubleshooting"]
    gone = changes(spark, longer, BASE)
    assert [r.heading for r in gone.filter("change = 'removed'").collect()] == ["Troubleshooting"]
    assert sections.delta_text(gone, "id").first().delta == "_Removed since then: Troubleshooting_"
    # of equal headings before, the last counts
    twice = changes(spark, "# A\n1\n# A\n2", "# a\n1\n# A\n2")
    assert [r.change for r in twice.orderBy("pos").collect()] == ["changed", "same"]
    assert changes(spark, None, None).isEmpty()
