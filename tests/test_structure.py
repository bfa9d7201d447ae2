"""Isolation of users and of the llm subpackage."""

import ast
import pathlib

from mnemoloom.operators import knn

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    for path in (ROOT / "mnemoloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "mnemoloom").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_users_with_equal_vectors_stay_apart(spark):
    rows = [(u, f"{u}{i}", [1.0, float(i)]) for u in ("a", "b") for i in range(4)]
    df = spark.createDataFrame(rows, "user_id string, id string, embedding array<float>")
    hits = knn.nearest(df, df, 2, "id", "id").collect()
    assert len(hits) == 16 and all(r.probe[0] == r.hit[0] == r.user for r in hits)


def test_ties_go_by_id(spark):
    df = spark.createDataFrame([("a", x, [1.0, 0.0]) for x in "zyxw"], "user_id string, id string, embedding array<float>")
    assert [r.hit for r in knn.nearest(df.where("id = 'z'"), df, 2, "id", "id").orderBy("rn").collect()] == ["w", "x"]


def test_queries_and_sql_have_the_same_names():
    from mnemoloom.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
