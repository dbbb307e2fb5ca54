"""A bridge of lists is made row by row."""

import contextlib
import io

from pyspark.sql import functions as F

from lectern.operators import model


def test_lists_are_settled_in_their_rows(spark):
    rows = [(1, ["b", " B", "", "a", None, "ß", "SS", "a"]), (2, None), (3, []), (4, ["\t", "x"]), (None, ["q", "Q"]), (5, [f"w{k % 300}" for k in range(2000)])]
    lists = spark.createDataFrame(rows, "owner long, names array<string>")
    flat = lambda df: df.select("owner", F.posexplode("names").alias("pos", "name"))
    key = lambda df: sorted(map(str, df.select("owner", "normalized_name", "ord").collect()))
    ours = model.bridge(lists, "owner", "names")
    assert ours.dtypes == [("owner", "bigint"), ("normalized_name", "string"), ("ord", "int")]
    assert key(ours) == key(model.bridge_rows(flat(lists), "owner")) and ours.count() == 3 + 1 + 1 + 300
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        ours.explain()
    assert "Exchange" not in out.getvalue()  # no name is shuffled
    # an owner of several lists
    twice = lists.unionByName(spark.createDataFrame([(1, ["z", "z", "A"]), (None, ["", "q"])], lists.schema))
    assert key(model.bridge(twice, "owner", "names")) == key(model.bridge_rows(flat(twice), "owner"))
