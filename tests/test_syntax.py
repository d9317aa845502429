import random

import pytest
from delvework.operators import chunking, syntax
from hypothesis import given, settings
from hypothesis import strategies as st

CASES = {
    'rs': ('use a;\n#[inline]\npub fn one(a: u8) -> u8 {\n    "fn no() {";\n    0\n}\nmacro_rules! mac { () => {} }\npub struct S { a: u8 }\nstruct T(u8);\nimpl<T: A> Tr<T> for S<T> where T: B {\n    fn m(&self) { if a { b() } }\n    pub async fn n() {}\n}\nmod inner {\n    fn i() {}\n    impl X { fn y() {} }\n}\ntrait Q { fn d(&self) { } fn e(&self); }\nconst K: u8 = 1;\nenum E { A, B }\n', [(3, 6, 'one'), (7, 7, 'mac'), (8, 8, 'S'), (9, 9, 'T'), (11, 11, 'S<T><Tr<T>>::m'), (12, 12, 'S<T><Tr<T>>::n'), (15, 15, 'inner::i'), (16, 16, 'inner::X::y'), (18, 18, 'Q::d'), (19, 19, 'K'), (20, 20, 'E')]),
    'ts': ("import x from 'y';\nexport function f(a: {b: number} = {b: 1}): void {\n  g();\n}\nexport default class C<T> extends D {\n  private x = 1;\n  constructor(a: string) { super(); }\n  async m(a) { if (a) { b(); } }\n  get v() { return 1; }\n}\nexport interface I { a: string; }\nexport type U = \n  | A\n  | B;\nenum Z { A }\n", [(2, 4, 'f'), (7, 7, 'C::constructor'), (8, 8, 'C::m'), (9, 9, 'C::v'), (11, 11, 'I::a'), (12, 14, 'U'), (15, 15, 'Z')]),
    'go': ('package a\nfunc F(a int) (int, error) {\n}\nfunc (s *S) M() { x := `}` }\nfunc (T[K]) N() {}\ntype S struct {\n  a int\n}\n', [(2, 3, 'F'), (4, 4, '(S).M'), (5, 5, '(T).N'), (6, 8, 'S')]),
    'java': ('package a;\n@X\npublic class A<T> {\n  int f = g(1);\n  @Override\n  public <R> List<R> m(int a) throws E {\n    return n(a);\n  }\n  A() { }\n  class B { void k() {} }\n  abstract int z();\n}\n', [(5, 8, 'A::m'), (9, 9, 'A::A'), (10, 10, 'A::B::k')]),
    'c': ('#include <a.h>\ntypedef struct { int a; } S;\nstatic int f(int a, void (*cb)(int))\n{\n  if (a) { g(a); }\n  return 0;\n}\nint proto(int);\n', [(2, 2, 'S'), (3, 7, 'f')]),
    'cpp': ('namespace n { \ntemplate <typename T> T id(T x) { return x; }\nclass A : public B {\n public:\n  A() : x(1) {}\n  ~A() {}\n  int m() const override { return x; }\n  bool operator==(const A& o) const { return true; }\n};\n}\nvoid A::out(int x) { }\n', [(2, 2, 'n::template<>id'), (5, 5, 'n::A::A'), (6, 6, 'n::A::~A'), (7, 7, 'n::A::m'), (8, 8, 'n::A::operator=='), (11, 11, 'A::out')]),
    'cs': ('namespace N {\n  public class A {\n    public int P { get; set; }\n    [Fact]\n    public void M() { }\n    public A() {}\n  }\n}\n', [(3, 3, 'N::A::P'), (4, 5, 'N::A::M'), (6, 6, 'N::A::A')]),
    'rb': ('module M\n  class A < B\n    def f(a)\n      if a\n      end\n    end\n    def self.g; end\n  end\nend\ndef top\nend\n', [(3, 6, 'M::A::f'), (7, 7, 'M::A::self.g'), (10, 11, 'top')]),
    'js': ('function* gen() {}\nclass A { #p(x) { } static s() { return `}${a}`; } }\nconst z = () => { };\nexport default async function q() {}\n', [(1, 1, 'gen'), (2, 2, 'A::#p'), (4, 4, 'q')]),
}


@pytest.mark.parametrize("ext", sorted(CASES))
def test_symbols_of_each_language(ext):
    text, want = CASES[ext]
    assert syntax.symbols(text, ext) == want


@pytest.mark.parametrize(
    "ext, text, names",
    [
        ("rs", "fn a<'x>(s: &'x str) -> char { '}' }\nfn b() { r#\"} fn no() {\"# }\n// fn c() {}\n/* fn d() {} */\nfn e() {}", ["a", "b", "e"]),
        ("rs", "pub(crate) const fn a() {}\npub unsafe extern \"C\" fn b() {}\npub trait T: U {\n    fn m(&self) -> u8;\n    fn n(&self) {}\n}\npub static S: [u8; 2] = [1, 2];\ntype X = Y<{ 1 }>;\nmod only;\nfn z() {}", ["a", "b", "T::n", "S", "X", "z"]),
        ("js", "export default class A extends B {\n  static async *gen(a = {}) {\n  }\n  get x() { return {a: 1}; }\n  f = () => {};\n  if(a) {}\n}\nfoo(function inner() {\n});\nfunction z({a} = {}) {\n}", ["A::gen", "A::x", "z"]),
        ("ts", "declare function no(a: string): void;\nexport abstract class A<T> {\n  protected constructor(private a: B) {}\n  abstract b(): void;\n  c<U>(x: U): { y: U } { return {y: x}; }\n}\nexport const enum E { A }\ntype T = { a: b }\nfunction z() {}", ["A::constructor", "A::c", "E", "T", "z"]),
        ("go", "func (s *Set[K, V]) Add(k K) bool {\n}\nfunc New[T any](x T) *Set { return &Set{} }\ntype (\n\tA int\n)\ntype B interface {\n}\nvar f = func() {}", ["(Set).Add", "New", "B"]),
        ("java", "public record R(int a) {\n  public R {\n  }\n  static int s(int... x) { return x[0]; }\n}\ninterface I {\n  default void d() {\n    if (a) { b(); }\n  }\n  void e();\n}\nenum E {\n  A { void q() {} };\n  private final int x = new Foo() { void no() {} }.y();\n  int g() throws X, Y { return 1; }\n}", ["R::s", "I::d", "E::g"]),
        ("c", "#define X(a) { a }\nstatic inline unsigned long *f(const char *s, int n[2])\n{\n}\nint (*table[2])(int) = { a, b };\nstruct S { int a; };\nif_call(1) ;\nvoid g(void) {\n  while (x) { y(); }\n}\ntypedef int (*cb)(int);\n", ["f", "g", "cb"]),
        ("cpp", "namespace a::b {\nclass A final : public B<C> {\n  explicit A(int x) noexcept : y{x} {}\n  template <class T> void t(T x) { }\n  operator bool() const { return true; }\n  void no();\n};\n}\ntemplate <>\nint spec<int>(int x) { return x; }\nauto f() -> std::vector<int> { return {}; }\nusing X = Y<int>;", ["a::b::A::A", "a::b::A::template<>t", "a::b::A::operator bool", "template<>spec", "f", "X"]),
        ("cs", "namespace N;\npublic sealed record A(int X) {\n  [Fact]\n  public async Task<int> M<T>(T x) where T : class { return 1; }\n  public int P => 3;\n  public event Handler E { add {} remove {} }\n  private int f;\n}\ninterface I { void no(); int Q { get; } }", ["A::M", "A::P", "A::E", "I::Q"]),
        ("rb", "class A::B < C\n  attr_reader :x\n  def self.make(a) = new(a)\n  def ok?\n    if a then b end\n  end\n  class << self\n    def inner\n    end\n  end\nend\n# def no\n\"def no2\"\nmodule M; end\ndef ==(o)\nend", ["A::B::self.make", "A::B::ok?", "A::B::self::inner", "=="]),
    ],
)
def test_names(ext, text, names):
    assert [n for *_, n in syntax.symbols(text, ext)] == names


TOKENS = ["{", "}", "(", ")", "[", "]", ";", "\n", '"', "'", "`", "//", "/*", "*/", "#", "fn f", "class A", "impl X for Y", "def m", "end", "function g(", "int h(", "template<", "typedef", "=", "type T", "enum", "namespace", " ", "operator", "struct", ":", "=>"]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(syntax.EXTENSIONS)), st.lists(st.sampled_from(TOKENS), max_size=40))
def test_any_text_gives_lines_inside_of_it(ext, parts):
    text = "".join(parts)
    n = text.count("\n") + 1
    got = syntax.symbols(text, ext)
    assert all(1 <= a <= b <= n for a, b, _ in got) and len({a for a, *_ in got}) == len(got)


def test_syntax_chunks(spark):
    rows = [(f"a.{ext.upper()}" if ext == "go" else f"a.{ext}", "m", t) for ext, (t, _) in CASES.items()] + [("b.rs", None, "x;\n"), ("c.rs", "m", ""), ("d.rs", "m", None), (None, "m", "fn f() {}"), ("e.txt", "m", "fn f() {}")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_path string, module string, content string, id int")
    got = chunking.syntax_chunks(df, 3, 1).collect()
    for ext, (text, want) in CASES.items():
        mine = sorted((r.start_line, r.end_line, r.symbol_name) for r in got if r.file_path.lower() == f"a.{ext}" and not r.symbol_name.startswith("[imports/header]"))
        cut = [(o, min(o + 2, b), n if o == a else f"{n}(cont.+{o - a})") for a, b, n in want for o in range(a, b + 1, 3)]
        assert mine == cut, ext
    assert [(r.id, r.symbol_name) for r in got if r.file_path[0] != "a"] == [("b.rs:1-1", None)]
    assert chunking.syntax_chunks(df.where("false"), 3, 1).count() == 0
