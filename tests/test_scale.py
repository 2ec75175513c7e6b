"""Plans and running times that must hold for large tables."""

import contextlib
import io
import time

import pytest

from weftgraph.operators import resolve, usage
from weftgraph.sources import signatures


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string").checkpoint()


def asked(spark, *rows):
    return spark.createDataFrame(rows, "source string, module string").checkpoint()


@pytest.fixture(autouse=True)
def checkpoints(spark):
    resolve.settled(spark.range(1))


def test_files_are_not_broadcast_by_a_guess(spark):
    files, imports = listing(spark, "/ws/a/p/b.go", "/ws/p.py"), asked(spark, ("/ws/a/x.go", "h.org/a/p"), ("/ws/y.py", "p"))
    modules = spark.createDataFrame([("/ws/a", "h.org/a")], "config_dir string, module_name string")
    for found in (resolve.python(imports, files, "/ws"), resolve.go(imports, files, "/ws", modules)):
        assert "Broadcast" not in plan(found)
        assert found.count() == 1


def test_aliases_are_not_broadcast_by_a_guess(spark):
    aliases = spark.createDataFrame([("/ws", 0, "@l", "/ws/l")], "config_dir string, ordinal int, alias string, target string")
    found = resolve.by_alias(asked(spark, ("/ws/a.ts", "@l/x")), listing(spark, "/ws/l/x.ts"), aliases, "/ws")
    assert "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("/ws/a.ts", "@l/x", "/ws/l/x.ts")]


def test_stages_of_resolution_are_planned_one_by_one_and_only_if_there_is_a_source(spark, monkeypatch):
    def none(*_):
        raise AssertionError("no such source")

    for rule in ("rust", "java", "csharp", "swift", "go"):
        monkeypatch.setattr(resolve, rule, none)
    found = resolve.resolve(asked(spark, ("/ws/a.ts", "./x"), ("/ws/y.py", "p")), listing(spark, "/ws/x.ts", "/ws/p.py"), "/ws")
    assert "Join" not in plan(found)
    assert {r["target"] for r in found.collect()} == {"/ws/x.ts", "/ws/p.py"}


def test_a_scan_is_not_broadcast_by_a_guess(spark):
    files = spark.createDataFrame([("/ws/a.ts", "typescript", "import x from './lib/x';"), ("/ws/b.ts", "typescript", "f();")], "path string, lang string, text string").checkpoint()
    targets = listing(spark, "/ws/lib/x.ts")
    found = usage.scan_references(files, targets, lambda i: resolve.relative(i, targets))
    assert "Broadcast" not in plan(usage.scan_candidates(files, targets)) + plan(found)
    assert [tuple(r)[:2] for r in found.collect()] == [("/ws/lib/x.ts", "/ws/a.ts")]


def test_signatures_take_time_in_proportion_to_a_file():
    began = time.time()
    found = signatures.signatures("\n".join(f"export function s{k}(p{k}: N, q?: R): void {{}}" for k in range(20_000)))
    assert len(found) == 20_000 and found[-1]["line"] == 20_000
    assert time.time() - began < 40


def test_kinds_take_time_in_proportion_to_a_file():
    began = time.time()
    found = signatures.signatures("\n".join(f"class K{k} {{ constructor(private d: T) {{ }} m(): V {{ }} }} const v{k} = (x) => x;" for k in range(6_000)))
    assert len(found) == 18_000 and found[-2]["symbol"] == "K5999.m"
    assert time.time() - began < 40
