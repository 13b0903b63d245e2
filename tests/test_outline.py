"""Declarations and imports of samples written for each language, and outlines of whole files."""

import pytest

from quarrylake.operators import outline, scan

SAMPLES = {
    "python": [("class Lamp(Base):", "class", "Lamp"), ("    async def glow(self):", "function", "glow"), ("MAX_WATT: int = 9", "const", "MAX_WATT"), ("maximum = 3", None, None), ("classy = 1", None, None)],
    "javascript": [("export default class Pump {", "class", "Pump"), ("export async function flow(a) {", "function", "flow"), ("function* drops() {}", "function", "drops"), ("const $press = (x) => x * 2", "function", "$press"), ("export const LIMIT = 4", "const", "LIMIT"), ("const hidden = 4", None, None), ("return classify(x)", None, None)],
    "typescript": [
        ("export abstract class Valve {", "class", "Valve"), ("declare interface Pipe {}", "interface", "Pipe"), ("export const enum Flow { A }", "enum", "Flow"), ("type Litre = number", "type", "Litre"), ("namespace Plumbing.Parts {", "namespace", "Plumbing.Parts"),
        ("export declare function drain(): void", "function", "drain"), ("export const open: Opener = async () => {}", "function", "open"), ("export const taps = make({})", "const", "taps"), ("const inner = 1", None, None),
    ],
    "go": [("func (p *Pump) Start(n int) error {", "function", "Start"), ("func main() {", "function", "main"), ("type Tank struct {", "type", "Tank"), ("type Litre float64", "type", "Litre"), ("var x = 1", None, None)],
    "rust": [("pub(crate) async fn pour(x: u8) {", "function", "pour"), ("pub struct Jug {", "struct", "Jug"), ("enum Size { A }", "enum", "Size"), ("pub trait Holds {", "trait", "Holds"), ("impl<T> Holds for Jug<T> {", "impl", "Holds for Jug<T> "), ("macro_rules! fill {", "macro", "fill"), ("let f = 3;", None, None)],
    "java": [("public abstract class Mill {", "class", "Mill"), ("interface Grinds {", "interface", "Grinds"), ("public enum Grain { RYE }", "enum", "Grain"), ("    private static final Map<String, Integer> weigh(int a) {", "method", "weigh"), ("public record Sack(int kg) {}", "record", "Sack"), ("    private int kilos;", None, None), ("    public Mill() {", None, None)],
    "kotlin": [("data class Loaf(val g: Int)", "class", "Loaf"), ("suspend fun <T> bake(x: T) {", "function", "bake"), ("object Oven {", "object", "Oven"), ("interface Baker", "interface", "Baker"), ("val x = 1", None, None)],
    "c": [("static int knead(int a, char *b) {", "function", "knead"), ("typedef struct dough {", "struct", "dough"), ("int rest(void);", None, None), ("  x = knead(1, 2);", None, None)],
    "cpp": [("template <typename T> class Tray {", "class", "Tray"), ("struct Rack {", "struct", "Rack"), ("std::vector<int> Tray::slots(int n) const {", None, None), ("unsigned long weigh(const Rack& r) {", "function", "weigh")],
    "csharp": [("public sealed class Kiln {", "class", "Kiln"), ("internal struct Brick {", "struct", "Brick"), ("    public async Task<int> Fire(int t) {", "method", "Fire"), ("public interface IFires {", "interface", "IFires"), ("enum Heat { Low }", "enum", "Heat")],
    "ruby": [("class Wheel < Base", "class", "Wheel"), ("module Spokes", "module", "Spokes"), ("  def round?", "function", "round?"), ("klass = 1", None, None)],
    "php": [("final class Shelf {", "class", "Shelf"), ("    public static function put($x) {", "function", "put"), ("interface Holds {", "interface", "Holds")],
    "swift": [("public final class Lens {", "class", "Lens"), ("struct Ray {", "struct", "Ray"), ("protocol Bends {", "protocol", "Bends"), ("    private func focus(_ x: Int) {", "function", "focus"), ("enum Colour {", "enum", "Colour")],
    "scala": [("sealed abstract class Tree", "class", "Tree"), ("case object Leaf", "object", "Leaf"), ("case class Fruit(n: Int)", "class", "Fruit"), ("trait Grows {", "trait", "Grows"), ("  def water(x: Int) = x", "function", "water")],
    "shell": [("build() {", "function", "build"), ("function clean () {", "function", "clean"), ("echo hi", None, None)],
    "elixir": [("def plant(x) do", "function", "plant"), ("struct Bed {", "struct", "Bed"), ("x = 1", None, None)],
}
IMPORTS = {
    "python": [("import a.b.c", ["a.b.c"]), ("from ..up import z", ["..up"]), ("important = 1", [])],
    "javascript": [("import { a, b } from './near'", ["./near"]), ("const q = require('far')", ["far"]), ("importing()", [])],
    "tsx": [('import type X from "pkg/x"', ["pkg/x"])],
    "go": [('import "fmt"', ["fmt"]), ('\tlog "example.org/log"', ["example.org/log"]), ('\t"os"', ["os"]), ("x := 1", [])],
    "rust": [("use std::fmt;", ["std::fmt"])],
    "java": [("import static org.x.Y;", ["org.x.Y"])],
    "csharp": [("using System.Text;", ["System.Text"])],
    "ruby": [("require_relative 'lib/a'", ["lib/a"])],
    "php": [("use App\\Models;", ["App\\Models"])],
    "cpp": [("#include <vector>", ["vector"]), ('#include "near.h"', ["near.h"])],
    "swift": [("import UIKit", ["UIKit"])],
    "scala": [("import a.b._", ["a.b._"])],
    "kotlin": [("import a.b", [])],
    "shell": [("import a.b", [])],
}


@pytest.mark.parametrize("lang", SAMPLES)
def test_declarations(lang):
    for line, kind, name in SAMPLES[lang]:
        assert scan.declaration(line, lang) == ((kind, name) if kind else None), line


@pytest.mark.parametrize("lang", IMPORTS)
def test_imports(lang):
    for line, want in IMPORTS[lang]:
        assert scan.imports(line, lang) == want, line


def test_python_files():
    symbols, found = outline.of_python("m.py", '"""About."""\nimport os\nfrom .x import y\nTOP = 1\nclass A(Base):\n    """Doc."""\n    def m(self, n: int = 2) -> str: ...\nasync def go() -> None: ...\n')
    assert [s[:2] for s in symbols] == [("module", "m"), ("const", "TOP"), ("class", "A"), ("method", "m"), ("function", "go")] and found == ["os", ".x"]
    assert symbols[3][2:4] == ("def m(self, n: int=2) -> str", "A") and symbols[0][6] == "About."
    assert outline.of_python("bad.py", "def (= : nothing\nimport real_mod\n")[1] == ["real_mod"]


def test_files_by_lines():
    symbols, found = outline.outline("s.ts", "export class S {}\r\nexport const F = async () => {}\ninterface I {}\n" + "type L = " + "x" * 300, "typescript")
    assert [(s[0], s[1], s[4]) for s in symbols] == [("class", "S", 1), ("function", "F", 2), ("interface", "I", 3), ("type", "L", 4)] and len(symbols[3][2]) == 200 and found == []
    assert outline.outline("x.json", "class A", "json") == ([], [])


def test_markdown():
    assert [outline.heading(x) for x in ("#  A # b ##  ", "# #", "## \t", "#", "####### x", " # x", "#x", "###### \tZ")] == [(1, "A # b"), (1, "#"), None, None, None, None, None, (6, "Z")]
    assert [s[1] for s in outline.of_markdown("# a\n```\n# no\n~~~\n# no")[0]] == ["a"]
    symbols, _ = outline.of_markdown("# T\n~~~\n# no\n```\n# no\n~~~\n### S ##\n#none\n")
    assert [(s[0], s[1], s[4]) for s in symbols] == [("h1", "T", 1), ("h3", "S", 7)]
