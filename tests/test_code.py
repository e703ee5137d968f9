"""Functions of eight languages, by what a reader of the source would list."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.functions import code
from marlstone.operators import textproc

PYTHON = '''
# def commented(a): pass
TEXT = """
def quoted(a):
    pass
"""
class A:
    async def f(self, a: dict[str, tuple[int, int]] = {"k": (1, 2)}, *args, b=")", **kw) -> list[int]:
        # a remark
        r"""Does f.

        More.
        """

    def g[T](
        x: T,  # the first, of two
        /,
        y=lambda p, q: (p, q),
    ): 'one line'

def h(): pass
'''
JAVASCRIPT = """
/** Adds.
 * Twice. */
export default async function add(a, {b, c = [1, 2]} = {}, ...rest) { return f(a, "function no(x) {}"); }
const s = `function no2(y) {}`; // function no3(z) {}

function* gen([p, q], d = (1, 2)) {
  // yields
}
const r = x.replace(/function no4("/g, '');
function last() {}
"""
TYPESCRIPT = """
// Maps.
// All of them.
export function map<T, U extends Array<T>>(xs: Array<T>, f: (x: T, i: number) => U, opt?: Map<string, U>, n = 3): U[] { }
function one(this: Window, readonly: boolean) {}
"""
JAVA = """
package p; import q.R;
class A<T> extends B {
    /** The sum.
     *  Of both. */
    @Override @SuppressWarnings("x(y) {")
    public static <K, V extends Comparable<V>> Map<K, List<V>> sum(final Map<K, V> xs, @Named("a,b") int[] ys, String... more) throws IOException, X {
        if (xs.isEmpty()) { return new HashMap<>(call(1)); } else sum(a);
        for (int i = 0; i < f(i); i++) { }
    }
    abstract int size();
    A(int x) { super(x); }
}
"""
CPP = """
#define MACRO(x) int not_this(int x) { }
// Adds.
template <typename T> std::vector<std::pair<T, int>> add(const std::map<T, int>& m, int (*f)(int, int), char s[] = "a,b)") { return g(m); }
unsigned long A::size() const noexcept { if (x) { return y(z); } }
static int declared(int a, double);
Foo built(1, 2);
int nothing(void) { char c = '"'; const char* r = R"(int raw(int a) {)"; }
"""
GO = """
// Add adds.
func Add(a, b int, f func(int, string) error, rest ...map[string]int) (int, error) { return `func no(x int) {}` }
func (s *Server) Run(ctx context.Context) {
\t// runs
}
func Map[K comparable, V any](m map[K]V) {}
func types(int, string) {}
"""
RUBY = """
=begin
def no(a)
=end

# Greets.
def greet(name, greeting = "hi, (you)", *rest, key: 1, **opts, &block)
  puts "def no2(x)"
end
def self.plain a, b = 2
  # inside
end
def ready?; true; end
"""
RUST = """
/// Finds.
#[inline]
pub fn find<'a, T: Fn(i32) -> i32>(&'a self, mut xs: Vec<(i32, T)>, s: &str) -> Option<T> { let q = '"'; }
fn main() { /* starts */ }
"""
CASES = {
    "python": (PYTHON, [("f", ["self", "a", "args", "b", "kw"], "Does f.\n\nMore."), ("g", ["x", "y"], "one line"), ("h", [], "")]),
    "javascript": (JAVASCRIPT, [("add", ["a", "{b, c = [1, 2]}", "rest"], "Adds.\nTwice."), ("gen", ["[p, q]", "d"], "yields"), ("last", [], "")]),
    "typescript": (TYPESCRIPT, [("map", ["xs", "f", "opt", "n"], "Maps.\nAll of them."), ("one", ["this", "readonly"], "")]),
    "java": (JAVA, [("sum", ["xs", "ys", "more"], "The sum.\nOf both."), ("size", [], "")]),
    "cpp": (CPP, [("add", ["m", "f", "s"], "Adds."), ("A::size", [], ""), ("declared", ["a"], ""), ("nothing", [], "")]),
    "go": (GO, [("Add", ["a", "b", "f", "rest"], "Add adds."), ("Run", ["ctx"], "runs"), ("Map", ["m"], ""), ("types", [], "")]),
    "ruby": (RUBY, [("greet", ["name", "greeting", "rest", "key", "opts", "block"], "Greets."), ("plain", ["a", "b"], "inside"), ("ready?", [], "")]),
    "rust": (RUST, [("find", ["self", "xs", "s"], "Finds."), ("main", [], "starts")]),
}


@pytest.mark.parametrize("language", CASES)
def test_language(language):
    source, want = CASES[language]
    assert [tuple(f) for f in code.functions(source, language)] == want


def test_files(spark):
    rows = [(f"dir/{k}.{ext}", CASES[k][0]) for ext, k in (("py", "python"), ("JS", "javascript"), ("go", "go"))]
    files = spark.createDataFrame([*rows, ("a.py", None), ("b.py", ""), ("c.txt", "def f(): pass"), (None, "def f(): pass"), rows[0]], "path string, content string")
    found = textproc.code_functions(files).collect()
    want = [(path, i, *f) for path, text in [*rows, rows[0]] for i, f in enumerate(CASES[path.split("/")[1].split(".")[0]][1])]
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert textproc.code_functions(files, "cobol").count() == 0
    assert [r.name for r in textproc.code_functions(files.filter("path is null"), "python").collect()] == ["f"]
    assert textproc.code_functions(files.limit(0)).count() == 0


@given(st.sampled_from(code.LANGUAGES), st.lists(st.sampled_from(["def f", "function f", "func F", "int f", "fn f", "(", ")", "<", ">", "{", "}", "[", "]", ",", ";", ":", "=", "a", "int b", "'", '"', "`", '"""', "//", "/*", "*/", "#", "\n", " ", "->", "\\", "R\"(", "=begin", "é"])))
@settings(max_examples=300, deadline=None)
def test_any_text_ends(language, parts):
    for f in code.functions(" ".join(parts) + "".join(parts), language):
        assert f.name and all(f.parameters)


@pytest.mark.parametrize("language", code.LANGUAGES)
@pytest.mark.parametrize("piece", ["def f(a", "function f<a", "function f()", "int f(int a", "fn f<", "// x\nint f()\n", "def f()\n", "/*", '"', "func F(a int)\n", "(((", "int f() -> a ", "<"])
def test_time_grows_with_the_file(language, piece):
    code.functions(piece * 10, language)
    start = time.process_time()
    code.functions(piece * 30_000, language)
    assert time.process_time() - start < 5
