"""Facts of TypeScript and JavaScript files, by a tokenizer and a scan over matched brackets. One row for each file.

The tables are those of Python files. Files with syntax errors are analysed as far as their brackets match.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame

from gatecrest.sources.python_facts import denies, parsed

TOKEN = re.compile(r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|[-+*/%&|^]=|\S)""", re.S)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "async", "throw", "else", "do", "in", "of", "case", "delete", "void", "yield", "super", "import", "const", "let", "var", "class", "with"}
AGENTIC = re.compile(r"openai|anthropic|langchain|langgraph|modelcontextprotocol|mastra|elizaos|(^|/)ai($|/)|ai-sdk|llamaindex|autogen|crewai|semantic-kernel|copilotkit|genkit|agent", re.I)
EXECUTE = ("execute", "handler", "run", "func", "call", "invoke", "callback", "perform", "action", "start")
ACTION_WORDS = re.compile(r"action|tool|plugin|command|skill|provider|evaluator|capability", re.I)
REGISTER = re.compile(r"^(register|add|use|define|create|mount|install|attach)_?\w*(tool|action|plugin|command|handler|skill|function|agent|capability)s?$", re.I)
#: Parts of the name of a call that composes a runtime, of what it composes, and of its arguments.
COMPOSE, RUNTIMES = re.compile("create|compose|build|bootstrap|init|start"), re.compile("agent|dispatcher|orchestrator|pipeline|runtime|workflow")
REGISTRIES = re.compile("actions|capabilities|evaluators|handlers|plugins|services|tools", re.I)
LISTS = {"actions", "tools", "plugins", "services", "commands", "skills", "evaluators", "providers"}


class Script:
    def __init__(self, path: str, text: str) -> None:
        self.path, self.text, self.lines = path, text, text.splitlines()
        self.tables: dict[str, list[dict]] = {k: [] for k in ("functions", "calls", "names", "classes", "dispatch", "roots")}
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokenize()
        self.spans: list[tuple[int, int, str, str | None, list[str]]] = []  # body of each function: first and last token, name, class, parameters
        self.bodies: set[int] = set()  # their first tokens
        self.imports: dict[str, str] = {}
        self.class_at: list[tuple[int, int, str]] = []

    def tokenize(self) -> None:
        self.tok: list[str] = []
        self.pos: list[int] = []
        self.kind: list[str] = []
        at, text = 0, self.text
        while at < len(text):
            if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (not self.tok or self.tok[-1] in "(,=:[!&|?{};" or self.tok[-1] in ("return", "=>", "&&", "||")):
                m = REGEX.match(text, at)
                if m:
                    self.tok.append(m[0]), self.pos.append(at), self.kind.append("string")
                    at = m.end()
                    continue
            m = TOKEN.match(text, at)
            if m is None:
                break
            if m.lastgroup != "space":
                self.tok.append(m[0]), self.pos.append(at), self.kind.append(m.lastgroup)
            at = m.end()
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tok):
            if self.kind[i] == "op":
                if t in OPEN:
                    stack.append(i)
                elif t in CLOSE:
                    while stack and OPEN[self.tok[stack[-1]]] != t:
                        stack.pop()
                    if stack:
                        j = stack.pop()
                        self.match[j], self.match[i] = i, j

    def t(self, i: int) -> str:
        return self.tok[i] if 0 <= i < len(self.tok) else ""

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.pos[i] - 1) + 1

    def span(self, i: int, j: int) -> str:
        return self.text[self.pos[i] : self.pos[j - 1] + len(self.tok[j - 1])] if j > i and j <= len(self.tok) else ""

    def literal(self, i: int) -> str | None:
        return self.tok[i][1:-1] if i < len(self.tok) and self.kind[i] == "string" and self.tok[i][0] in "\"'`" else None

    def parts(self, i: int, j: int, sep: str = ",") -> list[tuple[int, int]]:
        """Token ranges between separators at the top level of tokens i to j."""
        out, start, k = [], i, i
        while k < j:
            if self.tok[k] in OPEN and k in self.match:
                k = self.match[k]
            elif self.tok[k] == sep and self.kind[k] == "op":
                out.append((start, k))
                start = k + 1
            k += 1
        return [p for p in [*out, (start, j)] if p[0] < p[1]]

    def chain(self, i: int, j: int) -> str | None:
        """The chain that tokens i to j spell; await, new, casts and parentheses around it are dropped."""
        while i < j and (self.tok[i] in ("await", "new") or self.tok[i] == "("):
            if self.tok[i] == "(":
                if self.match.get(i) != j - 1:
                    break
                j -= 1
            i += 1
        out = ""
        while i < j:
            t = self.tok[i]
            if self.kind[i] == "name" and t not in KEYWORDS and (not out or out.endswith(".")):
                out += t
            elif t in (".", "?.") and out:
                out += "."
            elif t in ("(", "[") and out and i in self.match and not out.endswith("."):
                out += "()" if t == "(" else "[]"
                i = self.match[i]
            elif t == "<" and out and re.match(r"<[\w\s.,<>\[\]|{}:'\"]*>", self.span(i, j)):
                k = i
                while k < j and self.tok[k] != ">":
                    k += 1
                i = k
            elif t in ("as", "!", "satisfies"):
                break
            else:
                return None
            i += 1
        return out.rstrip(".") or None

    def refs(self, i: int, j: int) -> list[str]:
        if i >= j:
            return []
        if self.tok[i] == "[" and self.match.get(i, -1) < j:
            return [r for a, b in self.parts(i + 1, self.match.get(i, i + 1)) for r in self.refs(a, b)]
        if self.tok[i] == "...":
            return self.refs(i + 1, j)
        if self.tok[i] == "{" and self.match.get(i, -1) < j:
            props = self.properties(i)
            name = self.schema_name(props)
            return ["#" + name] if name else []
        c = self.chain(i, j)
        return [c] if c else []

    def properties(self, i: int) -> dict[str, tuple[int, int]]:
        """Keys of an object literal and the tokens of their values; a method's are its own."""
        out = {}
        for a, b in self.parts(i + 1, self.match.get(i, i + 1)):
            k = a
            while self.t(k) in ("async", "get", "set", "*", "static") and self.t(k + 1) not in (":", "(", ","):
                k += 1
            key = self.literal(k) if self.kind[k] == "string" else self.tok[k]
            if self.kind[k] in ("name", "string") and key:
                out[key] = (k + 2, b) if self.t(k + 1) == ":" else (k, b)
        return out

    def schema_name(self, props: dict[str, tuple[int, int]]) -> str | None:
        kind, inner = props.get("type"), props.get("function")
        if kind and inner and self.literal(kind[0]) == "function" and self.tok[inner[0]] == "{":
            name = self.properties(inner[0]).get("name")
            return self.literal(name[0]) if name else None
        return None

    # functions
    def params(self, i: int) -> list[str]:
        out = []
        for a, _ in self.parts(i + 1, self.match.get(i, i + 1)):
            if self.tok[a] in ("{", "["):
                out.append(" ".join(x for x in self.tok[a + 1 : self.match.get(a, a + 1)] if re.match(r"[A-Za-z_$]", x)) or "_")
            else:
                while self.t(a) in ("public", "private", "readonly", "protected", "..."):
                    a += 1
                out.append(self.t(a))
        return out

    def arrow(self, i: int) -> tuple[int, int, list[str]] | None:
        """Body and parameters of a function that begins at token i, else None."""
        k = i + 1 if self.t(i) == "async" else i
        if self.t(k) == "function":
            k += 1
            while k < len(self.tok) and self.tok[k] != "(":
                k += 1
            return self.body(k)
        if self.kind[k : k + 1] == ["name"] and self.t(k + 1) == "=>":
            return (*self.block(k + 2), [self.tok[k]])
        if self.t(k) == "(" and k in self.match:
            e = self.match[k] + 1
            if self.t(e) == ":":
                while e < len(self.tok) and self.tok[e] not in ("=>", ";", "{", ","):
                    e += 1
            if self.t(e) == "=>":
                return (*self.block(e + 1), self.params(k))
        return None

    def block(self, i: int) -> tuple[int, int]:
        if self.t(i) == "{" and i in self.match:
            return i, self.match[i]
        k = i
        while k < len(self.tok) and self.tok[k] not in (";", ",", ")", "]", "}"):
            k = self.match.get(k, k) + 1 if self.tok[k] in OPEN else k + 1
        return i, k

    def body(self, paren: int) -> tuple[int, int, list[str]] | None:
        """Of a declaration or method, from its parameter list."""
        if paren not in self.match:
            return None
        e = self.match[paren] + 1
        if self.t(e) == ":":
            while e < len(self.tok) and self.tok[e] not in ("{", ";"):
                e += 1
        return (e, self.match[e], self.params(paren)) if self.t(e) == "{" and e in self.match else None

    def function(self, name: str, cls: str | None, found: tuple[int, int, list[str]], at: int, exported: bool = False, decorators: list[str] | None = None) -> None:
        lo, hi, params = found
        if lo in self.bodies:
            return
        self.bodies.add(lo)
        self.spans.append((lo, hi, name, cls, params))
        names = {x for p in params for x in p.split()}
        branches = stops = checks = False
        raised = []
        for k in range(lo, min(hi, len(self.tok))):
            if self.tok[k] == "throw":
                raised.append(self.t(k + 2) if self.t(k + 1) == "new" else self.t(k + 1))
            if self.tok[k] in ("if", "switch") and self.t(k + 1) == "(":
                branches = True
                e = self.match.get(k + 1, k + 1)
                checks |= bool(names & {*self.tok[k + 2 : e]})
                s, f = self.block(e + 1)
                stops |= bool({"throw", "return"} & {*self.tok[s : f + 1]}) or self.t(e + 1) in ("throw", "return")
        self.tables["functions"].append({"ord": at, "name": name, "cls": cls, "params": params, "decorators": decorators or [], "start": self.line(at), "end": self.line(min(hi, len(self.tok) - 1)), "gate": branches and stops and checks and any(denies(r) for r in raised), "decorator_gate": False, "exported": exported})

    def scan_functions(self) -> None:
        n = len(self.tok)
        for i in range(n):
            t = self.tok[i]
            if t == "class" and self.kind[i + 1 : i + 2] == ["name"]:
                b = i + 2
                while b < n and self.tok[b] != "{":
                    b += 1
                if b in self.match:
                    name, head = self.tok[i + 1], self.tok[i + 2 : b]
                    base = self.chain(i + 3, b) if head[:1] == ["extends"] and "implements" not in head else (head[1] if head[:1] == ["extends"] and len(head) > 1 else None)
                    self.tables["classes"].append({"ord": i, "name": name, "bases": [re.sub(r"\(\).*", "", base)] if base else [], "decorators": [], "line": self.line(i)})
                    self.class_at.append((b, self.match[b], name))
                    self.methods(b, name)
            elif t == "function" and self.kind[i + 1 : i + 2] == ["name"]:
                p = i + 2
                while p < n and self.tok[p] != "(":
                    p += 1
                if found := self.body(p):
                    self.function(self.tok[i + 1], None, found, i, "export" in self.tok[max(0, i - 3) : i])
            elif t in ("const", "let", "var") and self.kind[i + 1 : i + 2] == ["name"]:
                self.variable(i)
        for i in range(n):
            if self.tok[i] == "(" and i in self.match and i and (self.kind[i - 1] == "name" and self.tok[i - 1] not in KEYWORDS or self.tok[i - 1] == ">"):
                self.callbacks(i)

    def methods(self, b: int, cls: str) -> None:
        i, end = b + 1, self.match[b]
        while i < end:
            if self.tok[i] in OPEN and i in self.match:
                i = self.match[i] + 1
                continue
            if self.kind[i] == "name" and self.t(i + 1) == "(" and self.t(i - 1) not in (".", "=", "new", "@") and (found := self.body(i + 1)):
                decorators = [self.tok[k + 1] for k in range(max(b, i - 12), i) if self.tok[k] == "@"]
                self.function(self.tok[i], cls, found, i, False, decorators)
                i = found[1] + 1
                continue
            if self.kind[i] == "name" and self.t(i + 1) == "=" and (found := self.arrow(i + 2)):
                self.function(self.tok[i], cls, found, i)
                i = found[1]
            i += 1

    def variable(self, i: int) -> None:
        name, k = self.tok[i + 1], i + 2
        kind = ""
        if self.t(k) == ":":
            while k < len(self.tok) and self.tok[k] not in ("=", ";"):
                kind += self.tok[k]
                k += 1
        if self.t(k) != "=":
            return
        exported = "export" in self.tok[max(0, i - 1) : i]
        if found := self.arrow(k + 1):
            self.function(name, None, found, i, exported)
            return
        v = k + 1
        while self.t(v) in ("await", "new"):
            v += 1
        if self.t(v) == "{" and v in self.match:
            e = self.match[v] + 1
            if self.t(e) in ("as", "satisfies"):
                kind += self.t(e + 1)
            self.object(name, v, kind)

    def object(self, name: str, i: int, kind: str = "") -> None:
        """Functions that an object's properties hold get its name and the key."""
        props = self.properties(i)
        runs = []
        for key, (a, b) in props.items():
            found = self.arrow(a) or (self.body(a + 1) if self.t(a + 1) == "(" and self.kind[a] == "name" else None)
            if found:
                self.function(f"{name}.{key}", None, found, a)
                runs += [f"{name}.{key}"] if key in EXECUTE else []
            elif self.t(a) == "{":
                self.object(f"{name}.{key}", a)
            elif key in EXECUTE and (c := self.chain(a, b)):
                runs.append(c)
            if key in LISTS and self.t(a) == "[" and (ACTION_WORDS.search(kind) or self.agentic()):
                for k, (x, y) in enumerate(self.parts(a + 1, self.match.get(a, a + 1))):
                    for r in self.refs(x, y):
                        self.root(8, r, "plugin-array", f"{name}.{key}[{k}]")
        if runs and (ACTION_WORDS.search(kind) or ACTION_WORDS.search(name) or self.agentic() and ("name" in props or "description" in props)):
            eliza = any("elizaos" in m for m in self.imports.values())
            for r in runs:
                self.root(13 if eliza else 7, r, "elizaos" if eliza else "action-object", f"object {name}")

    def agentic(self) -> bool:
        return any(AGENTIC.search(m) for m in self.imports.values())

    def root(self, extractor: int, name: str, framework: str, evidence: str) -> None:
        self.tables["roots"].append({"ord": extractor * 1_000_000 + len(self.tables["roots"]), "name": name, "framework": framework, "evidence": evidence})

    def callee(self, paren: int) -> tuple[int, str | None]:
        """First token and chain of what is called at a parenthesis."""
        k = paren - 1
        if self.t(k) == ">":
            while k > 0 and self.tok[k] != "<":
                k -= 1
            k -= 1
        end = k + 1
        while k >= 0:
            if self.tok[k] in CLOSE and k in self.match:
                k = self.match[k] - 1
                continue
            if self.kind[k] == "name" and self.tok[k] not in KEYWORDS and self.t(k - 1) in (".", "?."):
                k -= 2
                continue
            break
        start = max(k, 0)
        return start, self.chain(start, end)

    def callbacks(self, p: int) -> None:
        """Functions passed as arguments, by the call they are passed to; and what such calls register."""
        start, called = self.callee(p)
        if not called:
            return
        last = called.split(".")[-1]
        args = self.parts(p + 1, self.match[p])
        given = next((self.literal(a) for a, b in args if b == a + 1 and self.literal(a)), None)
        before = self.t(start - 1)
        target = self.t(start - 2) if before == "=" else None
        if before == "new" and self.t(start - 2) == "=":
            target = self.t(start - 3)
        name = given if given and re.match(r"^[\w.-]+$", given) and (last in ("tool", "registerTool", "command", "action") or REGISTER.match(last)) else target if target and re.match(r"[A-Za-z_$]", target) else f"{called}@{self.line(p)}".replace("()", "")
        target_module = self.imports.get(called.split(".")[0].replace("()", ""), "")
        made: list[str] = []
        for a, b in args:
            if found := self.arrow(a):
                self.function(name, None, found, a)
                made.append(name)
            elif self.t(a) == "{" and a in self.match:
                runs = []
                for key, (x, y) in self.properties(a).items():
                    inner = self.arrow(x) or (self.body(x + 1) if self.t(x + 1) == "(" and self.kind[x] == "name" else None)
                    if inner:
                        self.function(f"{name}.{key}", None, inner, x)
                    if key in EXECUTE:
                        runs += [f"{name}.{key}"] if inner else self.refs(x, y)
                    if key == "tools" and ("agent" in last.lower() or last in ("streamText", "generateText", "bindTools", "create")):
                        runs += self.refs(x, y)
                        if self.t(x) == "{":
                            runs += [r for u, v in self.properties(x).values() for r in self.refs(u, v)]
                made += runs
            else:
                made += self.refs(a, b)
        modules = " ".join(self.imports.values())
        label = None
        if re.search("langgraph", target_module) and last in ("createReactAgent", "StateGraph"):
            label = (2, "langgraph")
        elif last in ("DynamicStructuredTool", "DynamicTool", "StructuredTool") or last == "tool" and "langchain" in target_module or last == "bindTools":
            label = (2, "langchain")
        elif target_module == "ai" and last in ("tool", "streamText", "generateText"):
            label = (3, "vercel-ai")
        elif "modelcontextprotocol" in modules and "." in called and last in ("tool", "registerTool", "setRequestHandler"):
            label = (4, "mcp")
        elif "mastra" in modules and last in ("createTool", "Agent"):
            label = (5, "mastra")
        elif REGISTER.match(last):
            label = (9, "registration")
        elif last in ("on", "once", "addListener", "addEventListener") and self.agentic():
            label = (11, "event-handlers")
        if label:
            for r in made:
                self.root(label[0], r, label[1], f"{called} at line {self.line(p)}")

    # bindings and calls
    def module(self, text: str) -> str:
        if text.startswith("."):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), text))
            path = re.sub(r"[.](js|ts|jsx|tsx|mjs)$", "", path)
            return re.sub("(^|/)index$", "", path).replace("/", ".")
        return re.sub("^node:", "", text)

    def bind(self, name: str, values: list[str], kind: str, at: int, fn: str | None = None, cls: str | None = None) -> None:
        self.tables["names"].append({"ord": at, "kind": kind, "fn": fn, "cls": cls, "name": name, "refs": values})

    def scan_imports(self) -> None:
        for i, t in enumerate(self.tok):
            if t == "import" and self.t(i + 1) not in ("(", "."):
                e = i + 1
                while e < len(self.tok) and self.tok[e] not in ("from", ";", "=", "import") and self.literal(e) is None:
                    e = self.match.get(e, e) + 1 if self.tok[e] == "{" else e + 1
                text = self.literal(e + 1) if self.t(e) == "from" else None
                if text is None:
                    continue
                for a, b in self.parts(i + 1, e):
                    if self.t(a) == "type":
                        a += 1
                    if self.t(a) == "{":
                        for x, y in self.parts(a + 1, self.match.get(a, a + 1)):
                            x += self.t(x) == "type" and y > x + 1
                            self.imported(self.tok[y - 1], text, self.tok[x], i)
                    elif self.t(a) == "*":
                        self.imported(self.tok[b - 1], text, None, i)
                    elif a < b:
                        self.imported(self.tok[a], text, "default", i)
            elif t == "require" and self.t(i + 1) == "(" and (text := self.literal(i + 2)):
                if self.t(i - 1) == "=" and self.t(i - 2) == "}" and i - 2 in self.match:
                    for x, y in self.parts(self.match[i - 2] + 1, i - 2):
                        self.imported(self.tok[y - 1], text, self.tok[x], i)
                elif self.t(i - 1) == "=" and self.kind[i - 2] == "name":
                    self.imported(self.tok[i - 2], text, None, i)

    def imported(self, alias: str, text: str, name: str | None, at: int) -> None:
        self.imports[alias] = text
        module = self.module(text)
        local = text.startswith(".")
        if name == "default":
            self.bind(alias, [f"@{module}.default"] if local else ["@" + module], "import", at)
        else:
            self.bind(alias, [f"@{module}.{name}" if name else "@" + module], "import", at)

    def owners(self) -> None:
        """The innermost function of each token: of those that hold it the one that begins last."""
        self.spans.sort()
        self.first = [s[0] for s in self.spans]
        self.owner = np.full(len(self.tok), -1, np.int32)
        for k, s in enumerate(self.spans):
            self.owner[s[0] : s[1] + 1] = k

    def scope(self, i: int) -> tuple[str | None, str | None, list[str]]:
        k = self.owner[i]
        return self.spans[k][2:] if k >= 0 else (None, None, [])

    def declares(self, paren: int, called: str, start: int) -> bool:
        """Whether a parenthesis holds the parameters of a function of that name, whose body begins soon after."""
        end = self.match[paren]
        if self.t(end + 1) not in ("{", ":") or self.t(start - 1) in (".", "("):
            return False
        lo, hi = bisect_right(self.first, paren), bisect_right(self.first, end + 12)
        return any(s[2].split(".")[-1] == called for s in self.spans[lo:hi])

    def scan_bodies(self) -> None:
        self.owners()
        flows: dict[tuple, dict[str, set[int]]] = {}
        for i, t in enumerate(self.tok):
            if t == "=" and self.kind[i] == "op" and i and (self.kind[i - 1] == "name"):
                k = i - 1
                while self.t(k - 1) == "." and k >= 2:
                    k -= 2
                name = self.chain(k, i)
                e = i + 1
                while e < len(self.tok) and self.tok[e] not in (";", ",", ")", "}", "]") and not (self.line(e) > self.line(e - 1) and self.tok[e] not in (".", "?.", "(", "[", "{", "&&", "||", "?", ":")):
                    e = self.match.get(e, e) + 1 if self.tok[e] in OPEN else e + 1
                fn, cls, params = self.scope(i)
                if name and self.t(k - 1) != ":" and "require" not in self.tok[i : i + 2]:
                    own = name.startswith("this.")
                    self.bind(name, self.refs(i + 1, e), "assign", i, None if own else fn, cls if own else cls if fn else None)
                    flow = flows.setdefault((fn, cls), {p: {k2} for k2, ps in enumerate(params) for p in ps.split()})
                    flow.setdefault(name, set()).update(x for w in self.tok[i + 1 : e] for x in flow.get(w, ()))
                if self.t(k - 1) == "}" and k - 1 in self.match or t == "=" and self.t(i - 1) == "}":
                    continue
            elif t == "return":
                fn, cls, _ = self.scope(i)
                e = i + 1
                while e < len(self.tok) and self.tok[e] not in (";", "}"):
                    e = self.match.get(e, e) + 1 if self.tok[e] in OPEN else e + 1
                if fn:
                    self.bind((f"{cls}." if cls else "") + fn + "()", self.refs(i + 1, e), "return", i, fn, cls)
            elif t == "(" and i in self.match and i and (self.kind[i - 1] == "name" and self.tok[i - 1] not in KEYWORDS - {"delete"} or self.tok[i - 1] == ">") and self.t(i - 2) not in ("function",):
                start, called = self.callee(i)
                if not called or self.declares(i, called, start):
                    continue
                fn, cls, params = self.scope(start)
                flow = flows.setdefault((fn, cls), {p: {k2} for k2, ps in enumerate(params) for p in ps.split()})
                args = []
                for a, b in self.parts(i + 1, self.match[i]):
                    words = self.tok[a:b]
                    args.append({"name": None, "text": self.header(a, b), "refs": self.refs(a, b), "literals": [x for k in range(a, b) if (x := self.literal(k))], "params": sorted({x for w in words for x in flow.get(w, ())})})
                self.composed(called, fn, i)
                row = self.lines[self.line(start) - 1].strip()
                self.tables["calls"].append({"ord": start, "line": self.line(start), "col": self.pos[start] - (self.breaks[self.line(start) - 2] + 1 if self.line(start) > 1 else 0), "chain": called, "callee": called.replace("()", "").replace("[]", ""), "snippet": row if len(row) <= 100 else row[:100] + "...", "fn": fn, "cls": cls, "args": args})

    def header(self, a: int, b: int) -> str:
        """An argument's text; of a function's only what comes before its body, which has calls of its own."""
        found = self.arrow(a)
        return self.span(a, min(b, found[0])) if found and found[0] > a else self.span(a, b)

    def composed(self, called: str, fn: str | None, paren: int) -> None:
        """A call that builds a runtime from registries makes its function a root."""
        name = called.replace("()", "").replace("[]", "").lower()
        if COMPOSE.search(name) and RUNTIMES.search(name) and any(REGISTRIES.search(self.span(a, b)) for a, b in self.parts(paren + 1, self.match[paren])):
            self.root(12, fn or called, "runtime-composition", f"{called} composes registries at line {self.line(paren)}")

    def scan_roots(self) -> None:
        modules = " ".join(self.imports.values())
        if re.search("openai", modules):
            for i, t in enumerate(self.tok):
                if t == "{" and i in self.match and (name := self.schema_name(self.properties(i))):
                    self.root(1, name, "openai", f"tool schema at line {self.line(i)}")
        if re.search("playwright|puppeteer", modules):
            for c in self.tables["calls"]:
                if c["fn"] and re.match(r"(.*[.])?page[.]", c["chain"]):
                    self.root(6, c["fn"], "playwright", f"{c['chain']} at line {c['line']}")
        for c in self.tables["classes"]:
            if any(b.endswith("Service") for b in c["bases"]):
                self.root(10, f"{c['name']}.start", "service-class", f"class {c['name']} extends {c['bases'][0]}")
            if any(b.split(".")[-1] in ("StructuredTool", "Tool", "DynamicTool") for b in c["bases"]):
                for f in self.tables["functions"]:
                    if f["cls"] == c["name"] and f["name"] in ("_call", "call", "invoke", "run", "execute"):
                        self.root(2, f"{c['name']}.{f['name']}", "langchain", f"class {c['name']} extends {c['bases'][0]}")
        if self.agentic():
            for f in self.tables["functions"]:
                if f["exported"]:
                    self.root(14, f["name"], "export-entry", "exported from a file with an agent framework")


def parse(path: str, text: str) -> tuple[dict[str, list[dict]] | None, str | None]:
    s = Script(path, text)
    s.scan_imports()
    s.scan_functions()
    s.scan_bodies()
    s.scan_roots()
    return s.tables, None


def script_facts(files: DataFrame) -> DataFrame:
    return parsed(files, ("typescript", "javascript"), parse)
