"""Facts of Python files: definitions, calls, name bindings, decorators, control flow. One row for each file.

Expressions are written as chains: names and attributes joined by dots, with ``()`` for a call and ``[]`` for a
subscript, as in ``connect().cursor().execute``. A chain that begins with ``@`` is an absolute module path, one that
begins with ``#`` the name that a tool schema declares.
"""

from __future__ import annotations

import ast
import posixpath
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gatecrest.sources.files import spread

ARG = "struct<name:string,text:string,refs:array<string>,literals:array<string>,params:array<int>>"
FUNCTION = "struct<ord:int,name:string,cls:string,params:array<string>,decorators:array<string>,start:int,end:int,gate:boolean,decorator_gate:boolean,exported:boolean>"
CALL = f"struct<ord:int,line:int,col:int,chain:string,callee:string,snippet:string,fn:string,cls:string,args:array<{ARG}>>"
NAME = "struct<ord:int,kind:string,fn:string,cls:string,name:string,refs:array<string>>"
CLASS = "struct<ord:int,name:string,bases:array<string>,decorators:array<string>,line:int>"
KEYED = "struct<name:string,key:string,ref:string>"
ROOT = "struct<ord:int,name:string,framework:string,evidence:string>"
SCHEMA = f"project string, file string, language string, error string, functions array<{FUNCTION}>, calls array<{CALL}>, names array<{NAME}>, classes array<{CLASS}>, dispatch array<{KEYED}>, roots array<{ROOT}>"

#: Files whose facts make one batch.
PARSED = 16
#: Parts of names of exceptions that refuse access, without dashes; and words that say so where they stand alone.
DENIALS = re.compile("|".join(("access(denied|error)", "auth(entication)?error", "authorization(error|exception)", "credentialserror", "forbidden", "insufficientpermissions", "notauthorized", "permission(denied|error|exception)", "policy(error|violation)", "security(error|exception)", "tokenerror", "unauthorized(error|exception)")))
_WORDS = ("access", "auth", "credential", "denied", "forbidden", "permission", "policy", "security", "token", "unauthorized") + tuple(f"{x}_?{y}" for y, xs in (("access", ("no",)), ("allowed", ("not",)), ("auth", ("check", "invalid", "require"))) for x in xs)
DENIAL_WORDS = re.compile(rf"\b({'|'.join(_WORDS)})\b", re.I)


def denies(exception: str) -> bool:
    """Whether an exception's name says that access is refused."""
    return bool(DENIALS.search(re.sub("[_-]", "", exception.lower())) or DENIAL_WORDS.search(exception))


def chain(e: ast.AST | None) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, (ast.Await, ast.NamedExpr, ast.Starred)):
        return chain(e.value)
    if isinstance(e, ast.Attribute):
        base = chain(e.value)
        return base and f"{base}.{e.attr}"
    if isinstance(e, (ast.Call, ast.Subscript)):
        base = chain(e.func if isinstance(e, ast.Call) else e.value)
        return base and base + ("()" if isinstance(e, ast.Call) else "[]")
    return None


def schema_name(e: ast.Dict) -> str | None:
    """The name that a literal tool schema of the function type declares."""
    at = {k.value: v for k, v in zip(e.keys, e.values) if isinstance(k, ast.Constant)}
    inner, kind = at.get("function"), at.get("type")
    if isinstance(inner, ast.Dict) and isinstance(kind, ast.Constant) and kind.value == "function":
        for k, v in zip(inner.keys, inner.values):
            if isinstance(k, ast.Constant) and k.value == "name" and isinstance(v, ast.Constant) and isinstance(v.value, str):
                return v.value
    return None


def refs(e: ast.AST | None, inside: bool = False) -> list[str]:
    """What a value may refer to: its chain, or those of its elements; inside a container also what an element wraps."""
    if isinstance(e, (ast.List, ast.Tuple, ast.Set)):
        out = [r for x in e.elts for r in refs(x, True)]
    elif isinstance(e, ast.Dict):
        name = schema_name(e)
        out = ["#" + name] if name else [r for x in e.values for r in refs(x, True)]
    elif isinstance(e, ast.BinOp):
        out = refs(e.left, True) + refs(e.right, True)
    elif isinstance(e, (ast.IfExp, ast.BoolOp)):
        out = [r for x in ([e.body, e.orelse] if isinstance(e, ast.IfExp) else e.values) for r in refs(x, inside)]
    elif isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp)):
        out = refs(e.elt, True) + [r for g in e.generators for r in refs(g.iter, True)]
    else:
        c = chain(e)
        out = [c] if c else []
        if inside and isinstance(e, ast.Call):
            out += [r for x in [*e.args, *(k.value for k in e.keywords)] for r in refs(x, True)]
        if isinstance(e, ast.Call) and chain(e.func) in ("list", "tuple", "set", "sorted") and e.args:
            out = refs(e.args[0], True)
    return list(dict.fromkeys(out))


def named(e: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(e) if isinstance(n, ast.Name)}


class Facts(ast.NodeVisitor):
    def __init__(self, path: str, text: str) -> None:
        self.path, self.lines = path, text.splitlines()
        self.fn: list[ast.AST] = []
        self.cls: list[ast.ClassDef] = []
        self.scope: list[ast.AST] = []
        self.tables: dict[str, list[dict]] = {k: [] for k in ("functions", "calls", "names", "classes", "dispatch", "roots")}
        self.flow: list[dict[str, set[int]]] = []
        self.n = 0

    def at(self) -> dict:
        method = bool(self.scope) and len(self.scope) > 1 and isinstance(self.scope[-2], ast.ClassDef)
        fn = self.fn[-1].name if self.fn else None
        return {"fn": fn, "cls": self.cls[-1].name if self.cls and (method or not self.fn or self._owner()) else None}

    def _owner(self) -> bool:
        """Whether the innermost function is a method of the innermost class."""
        f = self.scope.index(self.fn[-1])
        return f > 0 and isinstance(self.scope[f - 1], ast.ClassDef)

    def add(self, table: str, **row) -> None:  # noqa: ANN003
        self.tables[table].append({"ord": self.n, **row})
        self.n += 1

    def bind(self, name: str | None, values: list[str], kind: str = "assign", everywhere: bool = False) -> None:
        if not name:
            return
        here = self.at()
        if everywhere or not self.fn and not self.cls:
            here = {"fn": None, "cls": None}
        elif name.startswith("self."):
            here["fn"] = None
        self.add("names", kind=kind, name=name, refs=values, **here)

    # definitions
    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(chain, node.bases) if b]
        self.add("classes", name=node.name, bases=bases, decorators=[d for d in map(self.decorator, node.decorator_list) if d], line=node.lineno)
        for d in node.decorator_list:
            self.visit(d)
        self.cls.append(node)
        self.scope.append(node)
        for s in node.body:
            self.visit(s)
        self.scope.pop()
        self.cls.pop()

    @staticmethod
    def decorator(d: ast.AST) -> str | None:
        return chain(d.func if isinstance(d, ast.Call) else d)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        method = bool(self.scope) and isinstance(self.scope[-1], ast.ClassDef)
        params = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        self.add("functions", name=node.name, cls=self.cls[-1].name if method else None, params=params, decorators=[d for d in map(self.decorator, node.decorator_list) if d], start=node.lineno, end=node.end_lineno, gate=structural_gate(node, params), decorator_gate=gating_decorator(node), exported=False)
        for d in node.decorator_list:
            self.visit(d)
        self.fn.append(node)
        self.scope.append(node)
        self.flow.append(flows(node, params))
        for s in node.body:
            self.visit(s)
        self.flow.pop()
        self.scope.pop()
        self.fn.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    # bindings
    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.bind(a.asname or a.name.split(".")[0], ["@" + (a.name if a.asname else a.name.split(".")[0])], "import", True)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = node.module or ""
        if node.level:
            folder = posixpath.dirname(self.path)
            for _ in range(node.level - 1):
                folder = posixpath.dirname(folder)
            module = ".".join(x for x in (folder.replace("/", "."), module) if x)
        for a in node.names:
            self.bind(a.asname or a.name, [f"@{module}.{a.name}" if module else "@" + a.name], "import", True)

    def assigned(self, target: ast.AST, value: ast.AST) -> None:
        if isinstance(target, (ast.Name, ast.Attribute)):
            name = chain(target)
            self.bind(name, refs(value))
            if isinstance(value, ast.Dict):
                self.mapping(name, value)
        elif isinstance(target, ast.Subscript):
            name = chain(target.value)
            self.bind(name, refs(value, True), "element")
            if name and isinstance(target.slice, ast.Constant):
                self.keyed(name, target.slice.value, value)

    def mapping(self, name: str | None, value: ast.Dict) -> None:
        for k, v in zip(value.keys, value.values):
            if isinstance(k, ast.Constant):
                self.keyed(name, k.value, v)

    def keyed(self, name: str | None, key: object, value: ast.AST) -> None:
        ref = chain(value)
        if name and ref and isinstance(key, str):
            self.tables["dispatch"].append({"name": name, "key": key, "ref": ref})

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.assigned(t, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value:
            self.assigned(node.target, node.value)
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.bind(chain(node.target), refs(node.value, True), "element")
        self.generic_visit(node)

    def visit_For(self, node: ast.For) -> None:
        if isinstance(node.target, ast.Name):
            self.bind(node.target.id, refs(node.iter))
        self.generic_visit(node)

    def with_(self, node: ast.With | ast.AsyncWith) -> None:
        for item in node.items:
            if item.optional_vars is not None:
                self.bind(chain(item.optional_vars), refs(item.context_expr), "with")
        self.generic_visit(node)

    visit_With = visit_AsyncWith = with_

    def returned(self, node: ast.Return | ast.Yield) -> None:
        if node.value is not None and self.fn:
            here = self.at()
            self.add("names", kind="return", name=(f"{here['cls']}." if here["cls"] else "") + f"{here['fn']}()", refs=refs(node.value), **here)
        self.generic_visit(node)

    visit_Return = visit_Yield = returned

    def visit_Call(self, node: ast.Call) -> None:
        callee = chain(node.func)
        if isinstance(node.func, ast.Attribute) and node.args:
            name = chain(node.func.value)
            if node.func.attr in ("append", "extend", "add", "insert", "update"):
                self.bind(name, [r for a in node.args for r in refs(a, True)], "element")
            if node.func.attr == "update" and isinstance(node.args[0], ast.Dict):
                self.mapping(name, node.args[0])
        line = self.lines[node.lineno - 1].strip() if node.lineno <= len(self.lines) else ""
        args = [self.argument(None, a) for a in node.args] + [self.argument(k.arg, k.value) for k in node.keywords]
        text = ast.unparse(node.func)
        self.add("calls", line=node.lineno, col=node.col_offset + 1, chain=callee, callee=text, snippet=line if len(line) <= 100 else line[:100] + "...", args=args, **self.at())
        self.generic_visit(node)

    def argument(self, name: str | None, value: ast.AST) -> dict:
        literals = [n.value for n in ast.walk(value) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
        flow = self.flow[-1] if self.flow else {}
        return {"name": name, "text": ast.unparse(value), "refs": refs(value), "literals": list(dict.fromkeys(literals)), "params": sorted({p for n in named(value) for p in flow.get(n, ())})}


def flows(node: ast.AST, params: list[str]) -> dict[str, set[int]]:
    """For each local name the parameters that its value may come from: a closure over the function's assignments."""
    out = {p: {k} for k, p in enumerate(params)}
    steps = []
    for n in ast.walk(node):
        if isinstance(n, ast.Assign):
            steps += [(t.id, named(n.value)) for t in n.targets if isinstance(t, ast.Name)]
        elif isinstance(n, (ast.AnnAssign, ast.AugAssign)) and n.value is not None and isinstance(n.target, ast.Name):
            steps.append((n.target.id, named(n.value)))
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)) and isinstance(n.target, ast.Name):
            steps.append((n.target.id, named(n.iter)))
        elif isinstance(n, ast.withitem) and isinstance(n.optional_vars, ast.Name):
            steps.append((n.optional_vars.id, named(n.context_expr)))
    changed = True
    while changed:
        changed = False
        for target, sources in steps:
            new = set().union(*(out.get(s, set()) for s in sources)) - out.get(target, set())
            if new:
                out.setdefault(target, set()).update(new)
                changed = True
    return out


def control(node: ast.AST, params: list[str]) -> tuple[bool, bool, bool, list[str]]:
    """Whether a function branches, may raise or return within a branch, tests a parameter; the types it raises."""
    branches = stops = checks = False
    raised = []
    for n in ast.walk(node):
        if isinstance(n, ast.Raise) and n.exc is not None:
            raised.append(chain(n.exc.func if isinstance(n.exc, ast.Call) else n.exc) or "")
        if isinstance(n, ast.If):
            branches = True
            checks |= bool(named(n.test) & set(params))
            stops |= any(isinstance(x, (ast.Raise, ast.Return)) for s in [*n.body, *n.orelse] for x in ast.walk(s))
    return branches, stops, checks, raised


def structural_gate(node: ast.AST, params: list[str]) -> bool:
    """A function that tests a parameter, can stop the execution in a branch, and raises an exception that denies access."""
    branches, stops, checks, raised = control(node, params)
    return branches and stops and checks and any(denies(r) for r in raised)


def gating_decorator(node: ast.AST) -> bool:
    """A decorator whose wrapper can stop the execution in a branch."""
    inner = [n for n in ast.walk(node) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n is not node]
    names = {n.name for n in inner}
    if not any(isinstance(n, ast.Return) and n.value is not None and named(n.value) & names for n in ast.walk(node)):
        return False
    branches, stops, _, _ = control(inner[-1], [])
    return branches and stops


def parse(path: str, text: str) -> tuple[dict[str, list[dict]] | None, str | None]:
    """The tables of a file, or why it can't be parsed."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            facts = Facts(path, text)
            facts.visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return None, f"Syntax error: {e}"
    return facts.tables, None


def parsed(files: DataFrame, language: str, parser) -> DataFrame:  # noqa: ANN001
    """One row of facts for each readable file of the language; a file that can't be parsed has its error and no facts."""
    arrow = to_arrow_schema(T._parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, PARSED):
                rows = []
                for r in b.slice(s, PARSED).to_pylist():
                    tables, error = parser(r["file"], r["source"])
                    rows.append({"project": r["project"], "file": r["file"], "language": r["language"], "error": error, **(tables or {})})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    wanted = files.where((F.col("language") == language) & F.col("error").isNull()) if isinstance(language, str) else files.where(F.col("language").isin(*language) & F.col("error").isNull())
    return spread(wanted.select("project", "file", "language", "source")).mapInArrow(run, SCHEMA)


def python_facts(files: DataFrame) -> DataFrame:
    return parsed(files, "python", parse)
