"""Extents of brace languages: written samples, and nested code against a plain stack."""

import random

from quarrylake.operators import extents

SAMPLE = """class A {
  int x = 1; // not {
  void one() { call("}"); }
  void two()
  {
    if (x) { y(); } else { z(); }
  }
  abstract void none();
  static { void inner() {
    } }
}
function last() { return '{'; }
interface Empty {}
void open() {
  x();"""
SYMBOLS = [("A", 1, 11, None), ("one", 3, 3, "A"), ("two", 4, 7, "A"), ("none", 8, 8, "A"), ("inner", 9, 10, "A"), ("last", 12, 12, None), ("Empty", 13, 13, None), ("open", 14, 15, None)]


def test_samples(spark):
    files = spark.createDataFrame([("a", SAMPLE), ("b", "x"), ("c", None)], "path string, text string")
    files = files.unionByName(spark.createDataFrame([("long", 'class L { s = "' + '{ \\\\" ' * 200_000 + '";\n}')], files.schema))
    symbols = spark.createDataFrame([("long", "L", 1)] + [("a", n, s) for n, s, _, _ in SYMBOLS] + [("b", "x", 1), ("c", "y", 1), ("gone", "z", 1)], "path string, name string, start_line int")
    got = extents.brace_extents(symbols, files)
    rows = {(r["path"], r["name"]): (r["last_line"], r["owner"]) for r in got.collect()}
    assert rows == {("a", n): (e, o) for n, _, e, o in SYMBOLS} | {("long", "L"): (2, None), ("b", "x"): (1, None), ("c", "y"): (1, None)}
    body = {r["name"]: r["body"] for r in extents.bodies(got, files).collect()}
    assert body["one"] == '  void one() { call("}"); }' and body["inner"] == "  static { void inner() {\n    } }"
    assert extents.brace_extents(symbols.limit(0), files).count() == 0


def test_nested_code_against_a_stack(spark):
    draw, files, want, symbols = random.Random(6), [], set(), []
    for f in range(30):
        lines, stack = [], []

        def close():
            lines.append("}")
            name, start, owner = stack.pop()
            if name:
                want.add((f"f{f}", name, start, len(lines), owner))

        for k in range(draw.randint(0, 60)):
            if stack and draw.random() < 0.4:
                close()
            elif draw.random() < 0.5:
                owner = next((n for n, _, _ in reversed(stack) if n), None)
                lines.append(f"fn s{k}() {{")
                stack.append((f"s{k}", len(lines), owner))
                symbols.append((f"f{f}", f"s{k}", len(lines)))
            elif draw.random() < 0.5:
                lines.append("while x {")
                stack.append((None, 0, None))
            else:
                lines.append('say("}{") // }')
        while stack:
            close()
        files.append((f"f{f}", "\n".join(lines)))
    got = extents.brace_extents(spark.createDataFrame(symbols, "path string, name string, start_line int"), spark.createDataFrame(files, "path string, text string"))
    assert {(r["path"], r["name"], r["start_line"], r["last_line"], r["owner"]) for r in got.collect()} == want and len(want) > 200
