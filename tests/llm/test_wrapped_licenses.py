import textwrap

import pytest

from pyspark.sql import functions as F

from innsight.llm import licenses


@pytest.mark.parametrize("width", [20, 40, 72])
def test_wrapped_notices_meet_their_templates(spark, width):
    head = "Copyright of some people. "
    rows = []
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        for k, sign in enumerate(("", " * ", "# ")):
            rows.append((3 * i + k, "x\n\n" + "\n".join(sign + line for line in textwrap.wrap(head + t + ". All the rest of the file.", width)) + "\n\nend"))
    halves = licenses.TEMPLATES[1][1].split(" to any ")
    rows += [(900, "\n\n".join(halves)), (901, "\n *\n".join(halves)), (902, None), (903, "\n\n\n"), (904, ("word " * 40 + "\n").join(halves))]
    got = {r["doc_id"]: r for r in licenses.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(3 * len(licenses.TEMPLATES)) if licenses.TEMPLATES[i // 3][0] not in got[i]["labels"].split(",")] == []
    assert all(got[i]["labels"] == "" and got[i]["score"] == 0.0 for i in range(900, 905))


def test_the_filter_of_whole_texts_loses_nothing(spark):
    notices = [t for _, t in licenses.TEMPLATES]
    scattered = "\n\n".join(notices[1].split())  # its words all stand in the text, in no block
    rows = [(i, f"before\n{t}\nafter") for i, t in enumerate(notices)] + [(90, scattered), (91, None), (92, ""), (93, "license"), (90, scattered)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = licenses.base(docs, vocabulary=licenses._vocabulary(licenses.TEMPLATES)[1])
    passed = {r["doc_id"] for r in own.where(licenses.may_match(F.col("tokens"))).collect()}
    assert passed == {*range(len(notices)), 90}
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] < 90:
            assert licenses.TEMPLATES[r["doc_id"]][0] in r["labels"].split(",")
        else:
            assert (r["labels"], r["score"]) == ("", 0.0)
