import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orebed.errors import Diagnostic, Diagnostics, EngineError
from orebed.functions import buffers, scalars
from orebed.functions import identity as ids
from orebed.plans import hash_ir, lower
from orebed.plans.checker import compile_source
from orebed.plans.runtime import Engine, Interpreter, Invocation, Outer, Registry, Results, expression, float_value, outer_binary, render, stockable
from orebed.plans.syntax import Binary, Literal, Pipe, lex, parse, parse_expression
from orebed.queries import PROGRAM
from orebed.sources.world import Grants, SnapshotWorld, World, parse_i64

PPM = b"P3\n2 1\n255\n100 50 20 200 100 50\n"


def one(text, **kw):
    return Engine(**kw).run(text).last


# ---- syntax -------------------------------------------------------------------------------


def test_literals_and_precedence():
    e = parse_expression("1 + 2 * 3 == 7")
    assert isinstance(e, Binary) and e.op == "==" and e.left.op == "+" and e.left.right.op == "*"
    assert parse_expression("2/4") == Literal("fraction", (1, 2))
    assert isinstance(parse_expression("1 / 3"), Binary) and isinstance(parse_expression("1/3.0"), Binary)
    assert [t.kind for t in lex("1/3 1 / 3 1.5 'a'"[:13])][:5] == ["fraction", "integer", "sign", "integer", "float"]
    assert parse_expression(r'"a\n\"\\"').value == 'a\n"\\'
    assert isinstance(parse_expression("x | f | g(2)"), Pipe)
    assert len(parse("a = 1; b = [1,\n 2]\nc = {x: 1}\n\n// note\na |\n f").items) == 4


@pytest.mark.parametrize("text", ["1 +", '"open', "a < b < c", "[1,]", "f(1", "x | 3", "transform t() -> i64 { if true { return 1 } }", "1..2", "@", "x = ", "9223372036854775808", "1/0", '"\\q"', "transform t(a: i64) -> i64 { a *= 2 }"])
def test_syntax_errors(text):
    with pytest.raises((Diagnostic, Diagnostics)):
        parse(text)


def test_places_in_the_text():
    with pytest.raises(Diagnostic) as e:
        parse("a = 1\nb = (2")
    assert e.value.line == 2


# ---- checks -------------------------------------------------------------------------------


BAD = {
    "unknown name": "transform t(a: i64) -> i64 { return b }",
    "returns": "transform t(a: i64) -> f32 { return a }",
    "every path": "transform t(a: i64) -> i64 { b = a }",
    "already defined": "transform t(a: i64) -> i64 { a = 1; return a }",
    "one type": "transform t(a: i64) -> i64 { return a + 1.0 }",
    "does not support": "transform t(a: u8) -> u8 { return a + a }",
    "must be bool": "transform t(a: i64) -> i64 { if a { return a } else { return a } }",
    "cannot follow": "transform t(a: i64) -> i64 { return a; b = 1 }",
    "consumed": "transform t(b: Buffer) -> Buffer { c = buffer_zero(b); return b }",
    "consumed before": "transform t(b: Buffer, x: bool) -> Buffer { if x { c = buffer_zero(b) } else { }\nreturn b }",
    "owned Buffer": "transform t(b: BufferView) -> BufferView { for x in b.bytes { x = x }\nreturn b }",
    "exactly one": "transform t(b: Buffer) -> Buffer { for x in b.bytes { y = x }\nreturn b }",
    "needs u8": "transform t(b: Buffer) -> Buffer { for x, i in b.bytes { x = i }\nreturn b }",
    "outer": "transform t(a: i64) -> i64 { return [a] }",
    "uses env.read": 'transform t() -> i64 { return environment_i64("N") }',
    "unknown capability": "transform t() -> i64 uses disk.read { return 1 }",
    "declared twice": "transform t() -> i64 uses env.read, env.read { return 1 }",
    "unknown type": "transform t(a: i32) -> i64 { return 1 }",
    "stay inside": "struct S { x: i64 }\ntransform t(s: S) -> i64 { return s.x }",
    "given twice": "struct S { x: i64 }\ntransform t() -> i64 { s = S(1, x=2); return s.x }",
    "must be given": "struct S { x: i64, y: i64 }\ntransform t() -> i64 { s = S(1); return s.x }",
    "has no field": "struct S { x: i64 }\ntransform t() -> i64 { s = S(1); return s.z }",
    "recursive": "transform t(a: i64) -> i64 { return t(a) }",
    "reserved": "transform buffer_zero(a: i64) -> i64 { return a }",
    "positional": "transform f(a: i64) -> i64 { return a }\ntransform t(a: i64) -> i64 { return f(a=a) }",
    "takes 1": "transform f(a: i64) -> i64 { return a }\ntransform t(a: i64) -> i64 { return f(a, a) }",
    "must be bool, u8": "struct S { x: Buffer }",
}


@pytest.mark.parametrize("message", BAD)
def test_rejected_programs(message):
    with pytest.raises(Diagnostics) as e:
        compile_source(BAD[message])
    assert message in str(e.value)


def tid(text, name="t"):
    return compile_source(text).transforms[name].id


def test_identity_ignores_names_and_layout():
    a = tid("transform t(x: i64, y: i64) -> i64 { z = x + y; return z }")
    assert a == tid("// same\ntransform u(a: i64, b: i64) -> i64 {\n  c = a + b\n  return c\n}", "u")
    assert tid("transform f(x: i64) -> i64 { return x }\ntransform t(x: i64) -> i64 { return f(x) }") == tid("transform t(x: i64) -> i64 { return g(x) }\ntransform g(q: i64) -> i64 { return q }")
    assert tid("transform t(b: Buffer, v: u8) -> Buffer { for x in b.bytes { x = v }\nreturn b }") == tid("transform t(b: Buffer, v: u8) -> Buffer { return buffer_fill(b, v) }")
    assert tid("transform t(b: Buffer) -> Buffer { for x, i in b.bytes { x = x }\nreturn b }") == tid("transform t(b: Buffer) -> Buffer { for x in b.bytes { x = x }\nreturn b }")
    assert tid("struct S { a: i64 }\ntransform t(x: i64) -> i64 { s = S(x); return s.a }") == tid("struct Q { b: i64 }\ntransform t(x: i64) -> i64 { s = Q(b=x); return s.b }")
    assert tid("transform t() -> i64 uses env.read, file.read { return 1 }") == tid("transform t() -> i64 uses file.read, env.read { return 1 }")


def test_identity_tells_meanings_apart():
    texts = [
        "transform t(x: i64) -> i64 { return x + 0 }", "transform t(x: i64) -> i64 { return x }", "transform t(x: i64) -> i64 { return 0 + x }", "transform t(x: i64) -> i64 uses env.read { return x }",
        "transform t(x: i64) -> i64 { a = x * 2; return a + a }", "transform t(x: i64) -> i64 { return (x * 2) + (x * 2) }", "transform t(x: i64, y: i64) -> i64 { return x }", "transform t(x: i64, y: i64) -> i64 { return y }",
        "transform t(x: f32) -> f32 { return x }", "transform t(x: f32) -> f32 { return x + 0.0 }", "transform t(b: Buffer) -> Buffer { for x in b.bytes { x = x }\nreturn b }", "transform t(b: Buffer) -> Buffer { return buffer_zero(b) }",
        "transform t(x: bool) -> i64 { if x { return 1 } else { return 2 } }", "transform t(x: bool) -> i64 { if x { return 2 } else { return 1 } }",
    ]
    assert len({tid(x) for x in texts}) == len(texts)


def test_encoding_of_one_node():
    ns = ids.Namespace("ab", "cd")
    raw = hash_ir.encode(hash_ir.GraphNode("a", "bc"), ns)
    assert raw == b"AB-HASH-IR\0" + struct.pack("<II", 1, 1) + b"\x01\0\0\0a\x02\0\0\0bc" + struct.pack("<III", 1, 0, 0)
    shared, twice = hash_ir.GraphNode("a", "x"), hash_ir.GraphNode("a", "x")
    pair = lambda p, q: hash_ir.GraphNode("a", "r", {"l": (hash_ir.NODE, p), "r": (hash_ir.NODE, q)})
    assert hash_ir.encode(pair(shared, shared)) != hash_ir.encode(pair(shared, twice))
    loop = hash_ir.GraphNode("a", "loop")
    loop.fields["self"] = (hash_ir.NODE, loop)
    assert len(hash_ir.discover(loop)) == 1 and hash_ir.encode(loop)


# ---- evaluation ---------------------------------------------------------------------------


def test_outer_arithmetic():
    assert one("7 / 2").value == 3 and one("(0 - 7) / 2").value == -3
    assert one("1/3 + 1/6").value == (1, 2) and one("1/2 == 2/4").value is True and one("1/3 < 1/2").value is True
    assert one("1.5 * 2.0 == 3.0").value and one("null == null").value
    assert one("1.0 / 0.0").value == 0x7F800000
    nan = Outer("float", 0x7FC00000)
    assert outer_binary("!=", nan, nan).value and not outer_binary("==", nan, nan).value and not outer_binary("<=", nan, nan).value
    for bad in ("1 + 1.0", "9223372036854775807 + 1", "1 / 0", "[1] == [1]", '"a" < "b"', "1/2 / (1/2 - 1/2)", "true + true", "{a: 1, a: 2}", "x", "f(1)", "a = 1\na = 2"):
        with pytest.raises(EngineError):
            one(bad)


def test_builtins():
    assert one("fraction(0 - 6, 4)").value == (-3, 2)
    assert one("f32.from_fraction(1/3)").value == int(np.float32(1 / 3).view(np.uint32))
    assert one("f32.from_bits(2147483648)").value == 1 << 31
    with pytest.raises(EngineError):
        one("fraction(1, 0)")
    with pytest.raises(EngineError):
        one("f32.from_bits(4294967296)")
    with pytest.raises(EngineError):
        one('read(asset("x"))')
    with pytest.raises(EngineError):
        one("trace(1)")


PIPE = PROGRAM + '\ndecoded = asset("a.ppm") | read | ppm.decode\nout = decoded | darken(0.5) | ppm.encode\nout | save("b.ppm")\n'


def run(results=None, world=None):
    saved = {}
    e = Engine(world or World(assets=lambda name: PPM), results=results, save=saved.__setitem__)
    return e, e.run(PIPE), saved


def test_image_pipeline_lineage_and_reuse():
    e, done, saved = run()
    assert saved["b.ppm"] == b"P3\n2 1\n255\n50 25 10 100 50 25\n" and e.results.misses == 3
    text = render(done.last.lineage)
    assert text.splitlines()[0].startswith('#0 source "a.ppm" content=') and text.endswith("root = #3")
    again, twice, _ = run(e.results)
    assert again.results.misses == 3 and twice.last == done.last and twice.bindings["out"].lineage == done.bindings["out"].lineage
    assert [r for r, _ in stockable(done)] == done.produced and stockable(twice) == []
    assert again.replay(done.last).value == done.last.value
    changed = World(assets=lambda name: PPM.replace(b"100", b"101"))
    with pytest.raises(EngineError, match="changed"):
        again.replay(done.last, changed)
    third = Engine(World(assets=lambda name: PPM))
    third.run(PROGRAM)
    assert third.replay(done.last).value == done.last.value  # without any earlier result
    unknown = Engine(World(assets=lambda name: PPM))
    unknown.run("1")
    with pytest.raises(EngineError, match="available"):
        unknown.replay(done.last)


def test_recipe_expressions():
    e, done, _ = run()
    text = expression(done.last.lineage)
    assert e.run(PROGRAM + "\n" + text).last.value == done.last.value
    moved = expression(done.last.lineage, 'read(asset("z"))')
    assert e.run(PROGRAM + "\n" + moved).last.lineage.recipe != done.last.lineage.recipe
    with pytest.raises(EngineError):
        e.run(PROGRAM + "\n" + text.replace("0.5", "0.25"))
    with pytest.raises((EngineError, Diagnostic)):
        expression(done.last.lineage, "1\n2")
    r = np.random.default_rng(1)
    t = Engine()
    for bits in [0, 1, 1 << 31, 0x7F800000, 0xFF800000, 0x7FC00001, 0x3F800000, 0x00800000, *r.integers(0, 2**32, 60).tolist()]:
        v = t.run(f"transform t(x: f32) -> f32 {{ return x }}\nt(f32.from_bits({bits}))").last
        text = expression(v.lineage)
        assert t.run("transform t(x: f32) -> f32 { return x }\n" + text).last.value == bits


def test_pins():
    full = tid("transform t(x: i64) -> i64 { return x }")
    source = "transform t(x: i64) -> i64 { return x }\n"
    assert one(source + f"t#{full[:6]}(1)").value == 1 and one(source + f"(t(1))#{one(source + 't(1)').lineage.recipe}").value == 1
    assert one(f"1#{ids.content('integer', 1)[:8]}").value == 1
    wrong = "0" if full[0] != "0" else "1"
    for bad in (source + f"t#{wrong}(1)", f"1#{wrong * 8}", 'asset("a")#00'):
        with pytest.raises(EngineError):
            one(bad)
    with pytest.raises(EngineError, match="ambiguous"):
        Engine(known_ids=lambda d, p: [p + "f" * (64 - len(p))]).run(f"1#{ids.content('integer', 1)[:2]}")


def test_arguments():
    s = "transform t(a: i64, b: i64) -> i64 { return a - b }\n"
    assert one(s + "t(b=1, a=5)").value == 4 and one(s + "5 | t(1)").value == 4 and one(s + "t(5, b=1)").value == 4
    for bad in ("t(1)", "t(1, 2, 3)", "t(1, a=2)", "t(1, c=2)", "t(1, 2.0)"):
        with pytest.raises(EngineError):
            one(s + bad)
    r = "transform t(a: u8) -> u8 { return a }\n"
    assert one(r + "t(255)").value == 255
    with pytest.raises(EngineError):
        one(r + "t(256)")


def test_results_are_proven():
    r = Results()
    r.store("x", Outer("integer", 1))
    assert r.lookup("x").value == 1 and r.lookup("y") is None
    with pytest.raises(EngineError, match="two contents"):
        r.store("x", Outer("integer", 2))
    r.values[r.contents["x"]] = Outer("integer", 9)
    assert r.lookup("x") is None and r.invalidations == 1 and (r.hits, r.misses) == (1, 2)


# ---- the world ------------------------------------------------------------------------------


def test_world(tmp_path):
    (tmp_path / "config.bin").write_bytes(b"first")
    grants = Grants.load({"environment": ["N", "S"], "retain_environment": ["S"], "http_prefixes": ["https://a.test/v1/"]}, tmp_path)
    env = {"N": "+42", "S": "text"}
    world = World(grants, tmp_path, environ=env, fetch=lambda url: b"body " + url.encode())
    source = 'transform n() -> i64 uses env.read { return environment_i64("N") }\ntransform f(p: StringView) -> Bytes uses file.read { return file.read(p) }\ntransform h(u: StringView) -> Bytes uses http.get { return http.get(u) }\ntransform e(k: StringView) -> String uses env.read { return env.read(k) }\n'
    run = lambda text, w=world: Engine(w).run(source + text).last
    assert run("n()").value == 42 and run('e("S")').value == "text" and run('h("https://a.test/v1/x")').value == b"body https://a.test/v1/x"
    value = run('f("config.bin")')
    assert value.value == b"first" and value.lineage.observations[0].capability == "file.read"
    for bad in ('f("../x")', 'f("none")', 'e("PATH")', 'h("https://b.test/")', 'h("https://a.test/v2/")'):
        with pytest.raises((EngineError, OSError)):
            run(bad)
    (tmp_path / "config.bin").write_bytes(b"changed")
    engine = Engine(world)
    engine.run(source)
    with pytest.raises(EngineError, match="changed"):
        engine.replay(value)
    snap = SnapshotWorld({("file.read", b"config.bin"): b"first"}, world)
    assert engine.replay(value, snap).value == b"first"
    with pytest.raises(EngineError, match="snapshot"):
        engine.replay(value, SnapshotWorld({}, world))
    flip = iter([b"1", b"2"])
    with pytest.raises(EngineError, match="within one invocation"):
        Engine(World(grants, tmp_path, fetch=lambda u: next(flip))).run('transform t(u: StringView) -> Bytes uses http.get { a = http.get(u)\nreturn http.get(u) }\nt("https://a.test/v1/")')
    for bad in ({"environment": [], "retain_environment": ["S"]}, {"http_prefixes": ["ftp://x"]}, {"file_roots": ["nowhere"]}, {"other": 1}):
        with pytest.raises(EngineError):
            Grants.load(bad, tmp_path)
    for bad in (b"", b"1.0", b" 1", b"9223372036854775808", b"\xff"):
        with pytest.raises(EngineError):
            parse_i64(bad)


# ---- columns against the interpreter ----------------------------------------------------------


def test_columns_equal_interpreter(spark):
    m = compile_source(PROGRAM)
    i = Interpreter(m, World(), {})
    values = [(n, k) for n in (-7, 0, 9, 10, 25, 40, 41, 2**40) for k in (1, 2, 3)]
    df = spark.createDataFrame(values, "v long, s long")
    for r in df.select("v", "s", lower.lower(m, "clamp", F.col("v"), F.col("s"), F.lit(30)).alias("c")).collect():
        assert r.c == i.call(m.transforms["clamp"], [r.v, r.s, 30])
    rows = [(k, [2, 3], 5, bytes((7 * j + k) % 256 for j in range(10))) for k in range(5)]
    b = spark.createDataFrame(rows, "k int, shape array<long>, outer_stride long, data binary").select("k", buffers.make(F.col("shape"), F.col("outer_stride"), F.col("data")).alias("b"))
    for name, args in (("darken", [0.5]), ("dim", []), ("paint", [9]), ("clear", [])):
        got = b.select("k", lower.lower(m, name, F.col("b"), *[F.lit(a) for a in args]).getField("data").alias("d")).collect()
        for r in got:
            want = i.call(m.transforms[name], [((2, 3), 5, rows[r.k][3]), *[np.float32(a) if isinstance(a, float) else a for a in args]])
            assert bytes(r.d) == want[2]
    assert lower.strategy(m, "clamp")[0] == "expression" and lower.strategy(m, "darken")[0] == "arrow-udf"


def test_checked_failures_in_columns(spark):
    m = compile_source("transform add(a: i64, b: i64) -> i64 { return a + b }\ntransform div(a: i64, b: i64) -> i64 { if b == 0 { return 0 } else { return a / b } }\ntransform byte(a: u8) -> u8 { return a }")
    df = spark.createDataFrame([(2**63 - 1, 1), (5, 0)], "a long, b long")
    assert [r[0] for r in df.select(lower.lower(m, "div", F.col("a"), F.col("b"))).collect()] == [2**63 - 1, 0]
    for bad in (lower.lower(m, "add", F.col("a"), F.col("b")), lower.lower(m, "byte", F.col("a"))):
        with pytest.raises(PySparkException):
            df.select(bad).collect()


def test_registry():
    r = Registry()
    assert [x.name for x in r.listing()] == sorted(x.name for x in r.listing())
    p = r.register("mine.flip", lambda b: b[::-1], [("bytes", "bytes")], "bytes", 1, b"code")
    assert p.id != Registry().register("mine.flip", lambda b: b, [("bytes", "bytes")], "bytes", 1, b"other").id
    e = Engine(World(assets=lambda n: b"abc"), registry=r)
    v = e.run('asset("x") | read | mine.flip').last
    assert v.value == b"cba" and isinstance(v.lineage, Invocation)
    for bad in (("flip", "bytes"), ("mine.flip", "bytes"), ("a.b", "string")):
        with pytest.raises(EngineError):
            r.register(bad[0], lambda b: b, [("x", bad[1])], "bytes", 1, b"")
    assert e.invoke_by_name("png.encode", Outer("buffer", ((1, 1, 4), 4, b"\1\2\3\4"))).kind == "bytes"


def test_float_text():
    assert scalars.float_literal(0.5) == "0.5" and scalars.float_literal(-0.0) == "f32.from_bits(2147483648)" and float_value(0.25).value == 0x3E800000
