"""The lexer on fragments that patterns alone get wrong."""

import pytest

from textgraph.sources.lexer import LANGUAGES, blanked, closing, items


def named(text, language):
    return {i.symbol: i for i in items(text, language)}


def test_comments_and_strings_are_blank():
    text = 'a("x(1)"); // b(2)\n/* c(3)\n */ d(\'e(4)\')'
    plain = blanked(text, LANGUAGES["typescript"])
    assert len(plain) == len(text) and plain.count("\n") == text.count("\n") and not any(f"{c}(" in plain for c in "xbce")
    assert blanked('r#"a "quoted" b"# x', LANGUAGES["rust"]).strip() == "x" and "lifetime" in blanked("fn f<'lifetime>()", LANGUAGES["rust"])
    assert closing("f(a; b) { if (x) { } } rest", 0, False) == 22 and closing("type A int\nrest", 4, True) == 10


def test_rust():
    text = "use std::{a, b};\n/// Doc.\npub struct One<T> { x: T }\nimpl<T> Two<T> { pub fn get(&self) -> T { help(\"a(b)\", 'x') } }\npub async fn run<'a>(a: &'a str) -> R\nwhere T: C {\n    if (a.len() > 1) { println!(\"{}\", other(a)); }\n}\nstruct Unit;\nmod inside { fn inner() {} }\n"
    own = named(text, "rust")
    assert list(own) == [None, "One", "Two", "run", "Unit", "inside"] and own[None].imports == ["std::{a, b}"]
    assert own["run"].calls == ["len", "other"] and (own["run"].start, own["run"].end) == (4, 8) and own["Two"].calls == ["help"]
    assert own["One"].doc == "/// Doc." and [own[n].kind for n in ("One", "run", "inside")] == ["class", "function", "module"]


def test_typescript():
    text = "import a from \"./m\";\nimport 'side';\n// import x from \"no\";\nexport class A extends B implements C, D {\n  constructor(private x: number) { super(x); }\n  run(a: string): void { this.go(a); if (a) { call(`t ${x(1)}`); } new T(1); }\n}\nexport interface I extends J { m(): void }\nexport const arrow = () => { inner(); };\nexport default { x: 1 };\nfunction plain() { return deep(1) }\nstart();\n"
    own = named(text, "typescript")
    assert own["A"].extends == ["B"] and own["A"].implements == ["C", "D"] and own["A"].calls == ["go", "call"] and own["A"].instantiates == ["T"]
    rows = items(text, "typescript")
    assert rows[0].imports == ["./m", "side"] and rows[0].calls == ["start"]
    assert [(i.symbol, i.owner) for i in rows if i.owner] == [("constructor", "A"), ("run", "A")]
    assert [i.start for i in rows if i.symbol is None] == [0, 9] and own["arrow"].calls == ["inner"] and own["plain"].calls == ["deep"]


def test_go_and_php():
    own = named('package main\nimport (\n  "fmt"\n  m "net/http"\n)\nimport "os"\ntype T struct { a int }\nfunc (t *T) Run(a int) error { s := "no"\n return do(a) }\nfunc main() { go run() }\n', "go")
    assert own[None].imports == ["fmt", "net/http", "os"] and own["Run"].calls == ["do"] and own["main"].calls == ["run"] and own["T"].kind == "interface"
    rows = items("<?php\nnamespace App;\nuse App\\Models\\User;\nuse \\Top\\Other as O;\nabstract class A extends \\Base\\B implements C, D {\n  public function run($x) { return $this->call(new \\App\\Thing()); }\n  private static function &go() { helper(); isset($x); }\n}\ninterface E extends F, G { public function m(); }\nfunction free() { A::make(); # no(1)\n}\n", "php")
    own = {i.symbol: i for i in rows}
    assert rows[0].imports == ["App\\Models\\User", "Top\\Other"] and own["A"].extends == ["Base\\B"] and own["A"].implements == ["C", "D"]
    assert own["A"].calls == ["call", "helper"] and own["A"].instantiates == ["Thing"] and own["E"].extends == ["F", "G"] and own["free"].calls == ["make"]
    assert [(i.symbol, i.owner) for i in rows if i.kind == "method"] == [("run", "A"), ("go", "A"), ("m", "E")]


@pytest.mark.parametrize("language", sorted(LANGUAGES))
@pytest.mark.parametrize("text", ["", "{", "}}}", "((((", '"', "'", "/*", "`", "fn", "class", "export", "use", "\0", "class A {" * 50, "a(" * 2000])
def test_any_text_is_read(language, text):
    assert items(text, language)[0].kind == "file"


def test_cost_is_linear_enough():
    text = "".join(f"export function f{k}(a) {{ return g{k}(a, 'x'); }}\n" for k in range(20_000))
    assert len(items(text, "typescript")) == 20_001
