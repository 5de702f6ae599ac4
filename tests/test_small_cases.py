"""Text functions and resolution on small cases."""

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import resolve

_TYPES = [("const std::string &", "string&"), ("java.util.List", "List"), ("int * ", "int*"), ("Foo", "Foo"), ("const char *", "char*")]
_SUMMARIES = [("findOrderByNumber", "Retrieves order by number"), ("decodeXMLFeed", "Decodes XML feed"), ("test_refund_total", "Tests refund total"), ("__init__", "Initializes instance"), ("warehouseShelves", "Warehouse shelves"), ("has_stock", "Checks whether stock")]
_RELATIVE = [("src/app", "../lib/x", "src/lib/x"), ("src", "./y", "src/y"), ("", "a/./b", "a/b"), ("a/b", "../../../c", "c")]
_SYMBOLS = [
    ("a.py::Shop", "Shop", "class", "a.py", "a.py", None, 1), ("a.py::Shop::__init__", "__init__", "function", "a.py", "a.py::Shop", None, 2),
    ("a.py::Shop::sell", "sell", "function", "a.py", "a.py::Shop", None, 3), ("a.py::Shop::pay", "pay", "function", "a.py", "a.py::Shop", None, 4),
    ("a.py::helper", "helper", "function", "a.py", "a.py", None, 5), ("b.py::Cart", "Cart", "class", "b.py", "b.py", None, 6),
    ("b.py::Cart::add", "add", "function", "b.py", "b.py::Cart", None, 7), ("b.py::total", "total", "function", "b.py", "b.py", None, 8),
    ("c.go::Run", "Run", "function", "c.go", "c.go", "Engine", 9), ("c.go::Stop", "Stop", "function", "c.go", "c.go", "Engine", 10),
]
_CALLS = [
    ("a.py::Shop::sell", "sell", "a.py", 1, "pay", "self", "attribute", None, None, None), ("a.py::Shop::sell", "sell", "a.py", 2, "missing", "self", "attribute", None, None, None),
    ("a.py::helper", "helper", "a.py", 3, "Shop", None, "bare", None, None, None), ("a.py::helper", "helper", "a.py", 4, "helper", None, "bare", None, None, None),
    ("a.py::helper", "helper", "a.py", 5, "total", "b", "attribute", None, None, None), ("b.py::total", "total", "b.py", 6, "helper", None, "bare", None, None, None),
    ("b.py::total", "total", "b.py", 7, "add", "cart", "attribute", None, None, {"cart": "Cart"}), ("b.py::total", "total", "b.py", 8, "add", "Cart", "attribute", None, None, None),
    ("a.py::helper", "helper", "a.py", 9, "Cart", None, "bare", None, None, None), ("c.go::Run", "Run", "c.go", 10, "Stop", "e", "attribute", "e", "Engine", None),
    ("b.py::total", "total", "b.py", 11, "nothing", None, "bare", None, None, None), ("b.py::total", "total", "b.py", 12, "sell", "Shop", "attribute", None, None, None),
]
_CALL_EDGES = [
    ("a.py::Shop::sell", "a.py::Shop::pay", 1.0), ("a.py::helper", "a.py::Shop::__init__", 1.0), ("a.py::helper", "b.py::total", 0.9),
    ("b.py::total", "a.py::helper", 0.8), ("b.py::total", "b.py::Cart::add", 0.7), ("a.py::helper", "b.py::Cart", 0.8), ("c.go::Run", "c.go::Stop", 1.0),
    ("b.py::total", "a.py::Shop::sell", 0.9),
]
_VARIABLES = [("a.py::f", "x", "a.py::f::x"), ("a.py::f", "y", "a.py::f::y"), ("a.py::Shop", "stock", "a.py::Shop::stock"), ("a.py", "G", "a.py::G")]
_REFS = [
    ("a.py::f::y", "a.py::f", "a.py", 1, "x", None, "identifier"), ("a.py::f::y", "a.py::f", "a.py", 2, "G", None, "identifier"),
    ("a.py::f::x", "a.py::f", "a.py", 3, "helper", None, "call"), ("a.py::Shop::sell::z", "a.py::Shop::sell", "a.py", 4, "stock", "self", "attribute"),
    ("a.py::f::x", "a.py::f", "a.py", 5, "total", "b", "attribute"), ("a.py::f::x", "a.py::f", "a.py", 6, "unknown", None, "identifier"),
]
_DERIVED = [("a.py::f::y", "a.py::f::x", "identifier"), ("a.py::f::y", "a.py::G", "identifier"), ("a.py::f::x", "a.py::helper", "call"), ("a.py::Shop::sell::z", "a.py::Shop::stock", "attribute"), ("a.py::f::x", "b.py::total", "attribute")]
_IMPORTS = [
    ("r/pkg/a.py", "pkg/a.py", "python", "util", "pkg.util", None, "r/pkg/util.py"), ("r/pkg/a.py", "pkg/a.py", "python", "core", ".core", None, "r/pkg/core/__init__.py"),
    ("r/pkg/a.py", "pkg/a.py", "python", "deep", ".", "deep", "r/pkg/deep.py"), ("r/pkg/a.py", "pkg/a.py", "python", "np", "numpy", None, None),
    ("r/web/x.ts", "web/x.ts", "typescript", "y", "./y", None, "r/web/y.tsx"), ("r/web/x.ts", "web/x.ts", "typescript", "lib", "../lib", None, "r/lib/index.ts"),
]
_FILES = ["pkg/a.py", "pkg/util.py", "pkg/core/__init__.py", "pkg/deep.py", "pkg/__init__.py", "web/x.ts", "web/y.tsx", "lib/index.ts"]


def symbols(spark):
    return spark.createDataFrame(_SYMBOLS, "node_id string, name string, kind string, file_id string, parent_id string, receiver_type string, seq int")


def imports(spark):
    return spark.createDataFrame([("a.py", "b", "b.py")], "file_id string, alias string, target_file_id string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_types(spark):
    got = spark.createDataFrame([(a,) for a, _ in _TYPES], "raw string").select("raw", text.normalise_type(F.col("raw")))
    assert rows(got) == sorted(_TYPES)


def test_summaries(spark):
    none = F.lit(None).cast("string")
    got = spark.createDataFrame([(a,) for a, _ in _SUMMARIES], "name string").select("name", text.summarise_function(F.col("name"), none, none))
    assert rows(got) == sorted(_SUMMARIES)


def test_relative_paths(spark):
    got = spark.createDataFrame([(a, b) for a, b, _ in _RELATIVE], "base string, path string").select("base", "path", text.resolve_relative(F.col("base"), F.col("path")))
    assert rows(got) == sorted(_RELATIVE)


def test_calls(spark):
    calls = spark.createDataFrame(_CALLS, "caller_id string, caller_name string, file_id string, ord int, name string, receiver string, kind string, receiver_var string, receiver_type string, param_types map<string,string>")
    assert rows(resolve.resolve_calls(calls, symbols(spark), imports(spark))) == sorted(_CALL_EDGES)


def test_derivations(spark):
    refs = spark.createDataFrame(_REFS, "variable_id string, scope_id string, file_id string, ord int, name string, receiver string, kind string")
    variables = spark.createDataFrame(_VARIABLES, "scope_id string, name string, var_id string")
    assert rows(resolve.resolve_derivations(refs, variables, symbols(spark), imports(spark))) == sorted(_DERIVED)


def test_imports(spark):
    asked = spark.createDataFrame([x[:6] for x in _IMPORTS], "file_id string, path string, language string, alias string, module string, member string")
    got = resolve.resolve_imports(asked, spark.createDataFrame([(f, f"r/{f}") for f in _FILES], "path string, file_id string"))
    assert rows(got) == sorted(((a, b, c, d) for a, _, _, b, c, _, d in _IMPORTS), key=repr)
