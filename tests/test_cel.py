"""The predicate language: parsing, gating by type, three-valued logic, rejected shapes."""

import pytest
from pyspark.sql import functions as F

from notegraph.errors import EngineError
from notegraph.plans import cel
from notegraph.plans.compile import compile_filter

DOCS = {
    1: '{"status":"draft","count":1,"tags":["pricing","saas"],"meta":{"owner":"ann","n":null}}',
    2: '{"status":"done","count":5,"tags":"pricing","flag":true}',
    3: '{"count":10.5,"tags":["other",3,null],"flag":"true"}',
    4: '{"status":7,"tags":null,"text":"50% off"}',
    5: '{"text":"50x off","tags":[],"count":"5"}',
}


@pytest.fixture(scope="module")
def live(spark):
    rows = [(i, f"dir/{i}.md", j, f"Body {i}.", f"2024-0{i}-01T00:00:00.000Z") for i, j in DOCS.items()]
    df = spark.createDataFrame(rows, "document_id long, path string, j string, body string, created_at string")
    return df.withColumn("frontmatter", F.parse_json("j")).drop("j").withColumn("content_hash", F.sha2("body", 256))


CASES = {
    'status == "draft"': [1],
    'status != "draft"': [2],
    'status == 7': [4],
    '!(status == "draft")': [2],
    "count > 1": [2, 3],
    "count == 5": [2],
    'count == "5"': [5],
    "-count <= -5": [2, 3],
    "count >= 1u && count < 0x0A": [1, 2],
    "flag": [2],
    "flag == true": [2],
    'flag == "true"': [3],
    "status == null": [],
    '"pricing" in list(tags)': [1, 2],
    "3 in list(tags)": [3],
    "size(list(tags)) == 0": [4, 5],
    "size(list(tags)) == 3": [3],
    'list(tags).exists(t, t.contains("ric"))': [1, 2],
    'list(tags).exists(t, t == 3 || t.startsWith("o"))': [3],
    'list(tags).all(t, t != "other")': [1, 2, 4, 5],
    'list(missing).all(t, t == "x")': [1, 2, 3, 4, 5],
    'meta.owner == "ann"': [1],
    "meta.owner.x == 1": [],
    'text.contains("50%")': [4],
    'startsWith(text, "50")': [4, 5],
    'text.endsWith("off") && text.matches("^50.")': [4, 5],
    "size($body) == 7": [1, 2, 3, 4, 5],
    '$path == "dir/2.md" || $updated_at >= "2024-05"': [2, 5],
    r'$path.matches(r"/[34]\.md$")': [3, 4],
    'status == "draft" && (count == 9 || count == 1)': [1],
    "count > 4 || true": [1, 2, 3, 4, 5],
}


@pytest.mark.parametrize("source", CASES)
def test_filters(live, source):
    got = compile_filter(source).apply(live)
    assert sorted(r.document_id for r in got.select("document_id").collect()) == CASES[source]


@pytest.mark.parametrize(
    "source",
    [
        "", "a ==", "a = 1", "(a", "a b", "[1]", "{}", "a ? b : c", "a + 1 == 2", "a[0] == 1", 'b"x" == a', "a in tags", "list(tags)", "has(a.b)", '$nope == "x"', "$path.x == 1",
        "size()", 'list(tags).exists(t, t.x == 1)', 'list(tags).exists(t, size(t) == 1)', 'list(tags).exists(t, t.matches("x"))', "list(tags).map(t, t)", "list(tags).exists_one(t, t == 1)",
        'a.matches("(?=x)")', r'a.matches("(a)\\1")', 'a.matches("(")', '$in("x")', "$links().size() > 1", '"text"', "list(1) == 2", "a.exists(t, t == 1)",
    ],
)
def test_rejected(source):
    with pytest.raises(EngineError) as e:
        compile_filter(source)
    assert e.value.code == "filter_invalid"


def test_strings():
    value = lambda s: cel.parse(s).value
    assert value(r'"a\né\x41\101"') == "a\néAA"
    assert value("'''it's'''") == "it's"
    assert value(r"r'\d'") == r"\d"


def test_precedence_and_binding():
    tree = cel.parse("a == 1 || b == 2 && !c")
    assert tree.name == "||" and tree.args[1].name == "&&"
    assert cel.names(cel.parse("$degrees < 2 && x.y == 1")) == {"$degrees", "x", "<", "&&", "=="}
    assert cel.bind(cel.parse("$degrees < 2"), "$degrees", 1) == cel.parse("1 < 2")


def test_names_without_calls():
    node = cel.parse('list(d.tags).exists(t, t == "x") && size(d.k) > 1')
    assert cel.names(node, calls=False) == {"d", "t"} and cel.names(node) >= {"d", "t", "size", "exists"}
