import json

import pytest
from pyspark.sql import functions as F

from orebed import cli
from orebed.errors import EngineError
from orebed.functions import identity as ids
from orebed.operators import catalog, lineage
from orebed.operators.checkpoints import checkpointer
from orebed.queries import PROGRAM
from orebed.sources import files
from orebed.workspace import CONFIG, Workspace

HERO = b"P3\n4 2\n255\n" + b" ".join(b"%d" % (k * 9 % 256) for k in range(24)) + b"\n"
SITE = PROGRAM + """
hero = asset("hero.ppm") | read | ppm.decode | darken(0.72)
png = hero | png.encode(compression=6)
webp = hero | webp.encode(quality=84)
small = hero | rgba.resize_nearest(2, 1) | darken(0.82)
thumb = small | png.encode
"""


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    w = Workspace.init(spark, root)
    w.import_bytes("hero.ppm", HERO)
    return w


def test_runs_record_stock_and_replay(site):
    first = site.run(SITE, record=("png",), stock=True)
    assert first["misses"] == 7 and len(first["stocked"]) == 7
    assert dict((n, mode) for n, _, mode, _ in first["plan"])["darken"] == "arrow-udf"
    again = site.run(SITE, stock=True)
    assert again["misses"] == 0 and again["stocked"] == [] and again["bindings"]["thumb"].value == first["bindings"]["thumb"].value
    recipe = first["recorded"]["png"]
    value = site.result(recipe)
    assert value.value == first["bindings"]["png"].value and site.stored_lineage(recipe) == first["bindings"]["png"].lineage
    assert site.trace(recipe).endswith("root = #3")
    assert site.replay(recipe, PROGRAM).value == value.value
    text = site.expression(recipe)
    assert site.run(PROGRAM + "\n" + text)["last"].value == value.value
    one = site.pipeline('asset("hero.ppm") | read | ppm.decode')
    assert one["hits"] == 1 and one["recipe"] in first["stocked"]
    with pytest.raises(EngineError):
        site.run(SITE, record=("png", "png"))
    with pytest.raises(EngineError):
        site.run("x = 1", record=("x",))
    assert site.verify()["object_issues"] == 0 and site.verify()["rule_issues"] == 0 and site.verify()["reference_issues"] == 0
    assert site.inspect_recipe(recipe)["content"] == value.content() and site.inspect_content(value.content())["recipe_count"] == 1
    assert site.search("png")["recipes"]["rows"] and site.recipes(transform="darken")["rows"] and site.summary(2)["transforms_truncated"]
    assert lineage.recomputed_recipes(site.tables()).where("recipe_id <> actual").isEmpty() and lineage.argument_issues(site.tables()).isEmpty()
    with pytest.raises(EngineError):
        site.expression("0" * 64)


def test_imports_versions_and_pages(spark, tmp_path):
    w = Workspace.init(spark, tmp_path / "w")
    base = tmp_path / "in"
    (base / "nested").mkdir(parents=True)
    for name in ("z.bin", "a.bin", "nested/m.bin"):
        (base / name).write_bytes(name.encode())
    extra = tmp_path / "extra"
    extra.write_bytes(b"z.bin")
    got = w.import_paths([str(extra), str(base)], recursive=True)
    assert [n.rpartition("/")[2] for n, _ in got] == ["extra", "a.bin", "m.bin", "z.bin"]
    with pytest.raises(EngineError):
        w.import_paths([str(base)])
    (base / "link").symlink_to(extra)
    with pytest.raises(EngineError):
        w.import_paths([str(base)], recursive=True)
    assert w.stats()["contents"] == 3 and w.stats()["source_heads"] == 4
    extra.write_bytes(b"newer")
    w.import_paths([str(extra)])
    assert w.read_source(str(extra)) == b"newer" and w.stats()["source_assets"] == 5
    seen, cursor = [], None
    while True:
        page = w.assets(limit=2, cursor=cursor)
        seen += [r["locator"] for r in page["rows"]]
        cursor = page["next_cursor"]
        if not page["truncated"]:
            break
    assert seen == sorted(seen) and len(seen) == 4
    assert len(w.assets(prefix=str(base))["rows"]) == 3
    for bad in (0, 101):
        with pytest.raises(EngineError):
            w.assets(limit=bad)
    with pytest.raises(EngineError):
        w.search("")
    content = ids.raw_content(b"newer")
    w.materialize(content, tmp_path / "out" / "x")
    assert (tmp_path / "out" / "x").read_bytes() == b"newer"
    with pytest.raises(EngineError):
        w.materialize(content, tmp_path / "out" / "x")
    with pytest.raises(EngineError):
        w.read_source("nothing")
    assert Workspace.discover(tmp_path / "w" / "catalog") == tmp_path / "w" and w.info()["version"] == 7
    (tmp_path / "w" / "catalog" / "catalog_version").write_text("8")
    with pytest.raises(EngineError):
        Workspace(spark, tmp_path / "w")


def test_corruption_is_found_and_not_repaired(spark, tmp_path):
    w = Workspace.init(spark, tmp_path)
    w.import_bytes("a", b"good")
    w.append({"objects": w.rows("objects", [(ids.raw_content(b"good"), bytearray(b"evil"))])})
    report = w.verify()
    assert report["object_issues"] == 1 and report["rule_issues"] == 1 and report["issues"][0]["issue"] == "content does not match its identity"
    with pytest.raises(EngineError):
        w.insert({"contents": w.rows("contents", [(ids.raw_content(b"good"), 9, "x", "raw")])})


def test_world_runs_and_snapshots(spark, tmp_path):
    (tmp_path / CONFIG).write_text('[world]\nenvironment = ["MODE"]\n')
    w = Workspace.init(spark, tmp_path)
    (tmp_path / "config.bin").write_bytes(b"first config")
    source = "transform load(p: StringView) -> Bytes uses file.read { return file.read(p) }\n"
    recipe = w.run(source + 'x = load("config.bin")', record=("x",))["recorded"]["x"]
    (tmp_path / "config.bin").write_bytes(b"changed config")
    with pytest.raises(EngineError):
        w.replay(recipe, source)
    assert w.replay(recipe, source, snapshot=True).value == b"first config"
    assert catalog.snapshots(w.tables()).count() == 1


def test_plugins(spark, tmp_path):
    code = b"def run(data):\n    return data[::-1]\n"
    (tmp_path / "p.py").write_bytes(code)
    manifest = 'name = "mine.flip"\nsemantic_version = 1\nabi_version = 4\nmodule = "p.py"\nmodule_content = "%s"\nresult = "bytes"\n[[parameters]]\nname = "bytes"\ntype = "bytes"\n'
    (tmp_path / "p.toml").write_text(manifest % ids.raw_content(code))
    (tmp_path / CONFIG).write_text('[plugins]\nmanifests = ["p.toml"]\n')
    w = Workspace.init(spark, tmp_path)
    w.import_bytes("a", b"abc")
    assert w.pipeline('asset("a") | read | mine.flip')["last"].value == b"cba" and [t["name"] for t in w.transforms("workspace")] == ["mine.flip"]
    for bad in (manifest % ("0" * 64), manifest % ids.raw_content(code) + "x = 1\n", (manifest % ids.raw_content(code)).replace("p.py", "../p.py")):
        (tmp_path / "p.toml").write_text(bad)
        with pytest.raises((EngineError, OSError, ValueError)):
            Workspace(spark, tmp_path)


def test_deep_and_cyclic_lineage(spark):
    rows = [(f"r{i}", "recipe", f"r{i - 1}") for i in range(1, 40)] + [("r39", "recipe", "r20")]
    args = spark.createDataFrame(rows, "recipe_id string, parent_kind string, parent_id string")
    keep = checkpointer(spark)
    got = {r.id: r.depth for r in lineage.ancestors(args, args.where("recipe_id = 'r39'"), keep=keep).collect()}
    assert len(got) == 40 and got["r20"] == 1 and got["r0"] == 21
    args.createOrReplaceTempView("t_args")
    lineage.edges(args).createOrReplaceTempView("t_edges")
    spark.createDataFrame([("r20",)], "recipe_id string").createOrReplaceTempView("t_roots")
    recursive = {r.id: r.depth for r in spark.sql(lineage.RECURSIVE.format(roots="t_roots", edges="t_edges", limit=60)).collect()}
    assert recursive == {r.id: r.depth for r in lineage.ancestors(args, args.where("recipe_id = 'r20'"), keep=keep).collect()}
    with pytest.raises(EngineError):
        lineage.ancestors(args, args.where("recipe_id = 'r39'"), limit=5, keep=keep)


def test_plans_push_predicates_down(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("locator"), F.lit(b"x").alias("data")).write.parquet(str(tmp_path / "t"))
    df = catalog.page_rows(catalog.where_all(spark.read.parquet(str(tmp_path / "t")).select("locator"), catalog.starts_with("locator", "1")), "locator", 5, "10")
    plan = df._jdf.queryExecution().toString()
    assert "StringStartsWith" in plan and "GreaterThan" in plan and "TakeOrderedAndProject" in plan and "data#" not in plan.split("Physical Plan")[1]


def test_command_line(spark, tmp_path, capsys):
    def run(*args, code=0):
        assert cli.main(["--json", "--workspace", str(tmp_path), *args]) == code
        out = capsys.readouterr()
        return json.loads(out.out if code == 0 else out.err)

    run("init")
    (tmp_path / "hero.ppm").write_bytes(HERO)
    run("import", str(tmp_path / "hero.ppm"))
    program = tmp_path / "p.txt"
    program.write_text(PROGRAM + f'\nx = asset("{tmp_path}/hero.ppm") | read | ppm.decode | dim | ppm.encode')
    recipe = run("run", str(program), "--record", "x")["recorded"]["x"]
    assert run("trace", recipe).startswith("#0 source") and run("replay", recipe, "--program", str(program))["kind"] == "bytes"
    assert run("stats")["recipe_results"] == 1 and len(run("transforms")) == 6 and run("plugins") == [] and run("verify")["objects_checked"] == 2
    assert "|" in run("expression", recipe) and run("recipes", "--transform", "ppm.encode")["rows"] and run("assets", "--limit", "1")["rows"]
    assert run("inspect", "recipe", recipe)["name"] == "ppm.encode" and run("search", "hero")["assets"]["rows"] and run("summary")["stats"] and run("info")["version"] == 7
    assert run("check", str(program))["transforms"] and "error" in run("trace", "0" * 64, code=1)
    with pytest.raises(SystemExit):
        cli.main(["assets", "--limit", "101"])


def test_save_each(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"1")), ("b/c", bytearray(b"2"))], "locator string, data binary")
    assert files.save_each(df, str(tmp_path)) == 2 and (tmp_path / "b" / "c").read_bytes() == b"2"


def test_stream_of_files(spark, tmp_path):
    from orebed import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"one")
    w = Workspace.init(spark, tmp_path / "w")
    q = streaming.ingest(streaming.watch_files(spark, str(tmp_path / "in")), w, str(tmp_path / "c"))
    q.awaitTermination()
    assert w.stats()["contents"] == 1


def test_a_deep_diamond_is_rebuilt_once_a_node(spark, tmp_path):
    w = Workspace.init(spark, tmp_path)
    w.import_bytes("a", b"start")
    content, transform = ids.raw_content(b"start"), ids.raw_content(b"join")
    source = ids.source("a", content)
    calls, args, last = [], [], ("source", source)
    for _ in range(26):  # both arguments derive from the same parent: 2 ** 26 paths
        recipe = ids.recipe(transform, [last, last], [])
        calls.append((recipe, transform, "join"))
        for i in range(2):
            args.append((recipe, i, "ab"[i], last[0], last[1], "bytes", None, content, last[0], last[1]))
        last = ("recipe", recipe)
    w.append({"lineage_invocations": w.rows("lineage_invocations", calls), "lineage_arguments": w.rows("lineage_arguments", args)})
    root, depth = w.stored_lineage(last[1]), 0
    while hasattr(root.arguments[0].parent, "arguments"):
        assert root.arguments[0].parent is root.arguments[1].parent
        root, depth = root.arguments[0].parent, depth + 1
    assert depth == 25


def test_every_issue_can_be_paged(spark, tmp_path):
    w = Workspace.init(spark, tmp_path)
    for k in range(5):
        w.import_bytes(f"a{k}", b"good%d" % k)
    w.append({"objects": w.rows("objects", [(ids.raw_content(b"good%d" % k), bytearray(b"evil")) for k in range(5)])})
    seen, cursor = [], None
    while True:
        report = w.verify(2, cursor)
        seen += [r["content_id"] for r in report["issues"]]
        cursor = report["issues_cursor"]
        if not report["issues_truncated"]:
            break
    assert sorted(set(seen)) == sorted(ids.raw_content(b"good%d" % k) for k in range(5)) and report["object_issues"] == 5
