"""Whole analyses of small projects: which tool reaches what, by which path, past which gate. All projects go in one run."""

import pytest

from gatecrest.plans import exposure
from gatecrest.sources import files

LC = "from langchain.tools import tool\n"
GATE = """
def guard(fn):
    def inner(user, *args):
        if not user.admin:
            raise PermissionError("no")
        return fn(user, *args)
    return inner
"""
PASS = """
def guard(fn):
    def inner(*args):
        print(args)
        return fn(*args)
    return inner
"""
PROJECTS = {
    "delete_elsewhere": {"app/agent.py": LC + "from app.disk import wipe\n@tool\ndef clean(path):\n    wipe(path)\n", "app/disk.py": "import shutil\ndef wipe(p):\n    shutil.rmtree(p)\n"},
    "langgraph_list": {"g.py": "from langgraph.prebuilt import create_react_agent\nfrom t import purge\ndef build(m):\n    return create_react_agent(m, [purge])\n", "t.py": "import shutil\ndef purge(x):\n    shutil.rmtree(x)\n"},
    "returned_bundle": {"g.py": "from langgraph.prebuilt import create_react_agent\nfrom t import bundle\ndef build(m):\n    return create_react_agent(m, tools=bundle())\n", "t.py": "import shutil\ndef purge(x):\n    shutil.rmtree(x)\ndef bundle():\n    return [purge]\n"},
    "openai_manifest": {
        "a.py": "from openai import OpenAI\nfrom t import calc, TOOLS\nclass Agent:\n    def __init__(self):\n        self.client = OpenAI()\n        self.tools = TOOLS\n        self.by_name = {'calc': calc}\n    def ask(self, q):\n        return self.client.chat.completions.create(model='m', tools=self.tools)\n",
        "t.py": "def calc(e):\n    return eval(e)\nTOOLS = [{'type': 'function', 'function': {'name': 'calc', 'parameters': {}}}]\n",
    },
    "openai_helper": {
        "a.py": "from openai import OpenAI\nfrom t import calc, make\nby_name = {}\nby_name['calc'] = calc\nclass Agent:\n    def __init__(self):\n        self.client = OpenAI()\n        self.tools = make()\n    def ask(self, q):\n        return self.client.chat.completions.create(model='m', tools=self.tools)\n",
        "t.py": "def calc(e):\n    return eval(e)\nTOOLS = [{'type': 'function', 'function': {'name': 'calc'}}]\ndef make():\n    return TOOLS\n",
    },
    "autogen_map": {"a.py": "from autogen import UserProxyAgent\nimport os\ndef drop(p):\n    os.remove(p)\nmapping = {'drop': drop}\nproxy = UserProxyAgent('x', function_map=mapping)\n"},
    "extended_list": {"a.py": "from langchain.agents import AgentExecutor\nimport os\ndef outer(p):\n    return inner(p)\ndef inner(p):\n    os.system(p)\ntools = []\ntools.extend([outer])\nexe = AgentExecutor(None, tools)\n"},
    "sinks": {"a.py": LC + "from pathlib import Path\nimport requests as rq\n@tool\ndef save(p, u):\n    Path(p).write_text('x')\n    rq.post(u)\n"},
    "parent_mkdir": {"a.py": LC + "from pathlib import Path\n@tool\ndef mk(p):\n    target = Path(p)\n    target.parent.mkdir()\n"},
    "with_open": {"a.py": LC + "@tool\ndef log(m):\n    with open('f', 'a') as h:\n        h.write(m)\n"},
    "smtp_helper": {"a.py": LC + "import smtplib\ndef connect():\n    c = smtplib.SMTP('h')\n    return c\n@tool\ndef mail(m):\n    connect().sendmail('a', 'b', m)\n"},
    "database": {"a.py": LC + "import sqlite3, redis\ncache = redis.Redis()\n@tool\ndef q(s):\n    with sqlite3.connect('d') as db:\n        cur = db.cursor()\n        cur.execute(s)\n    cache.set('k', s)\n"},
    "dispatch": {"a.py": LC + "import shutil\ndef rm(p):\n    shutil.rmtree(p)\nMAP = {'rm': rm}\n@tool\ndef do(k, p):\n    MAP[k](p)\n"},
    "open_modes": {"a.py": LC + "@tool\ndef w(p):\n    open(p, 'w')\n@tool\ndef r(p):\n    open(p)\n"},
    "input_flow": {"a.py": LC + "import shutil\n@tool\ndef drop(p):\n    target = p + '/x'\n    again = target\n    shutil.rmtree(again)\n@tool\ndef fixed(p):\n    shutil.rmtree('/tmp/x')\n"},
    "flow_by_call": {"a.py": LC + "import shutil\ndef low(a, where):\n    shutil.rmtree(where)\n@tool\ndef yes(p):\n    low(1, where=p)\n@tool\ndef no(p):\n    low(p, '/tmp')\n"},
    "own_decorator": {"a.py": "import shutil\ndef tool(f):\n    return f\n@tool\ndef drop(p):\n    shutil.rmtree(p)\n"},
    "two_tools": {"a.py": LC + "import os\ndef rm(p):\n    os.remove(p)\n@tool\ndef a(p):\n    rm(p)\n@tool\ndef b(p):\n    rm(p)\n"},
    "gated": {"a.py": LC + "from auth import guard\nimport os\n@guard\ndef rm(u, p):\n    os.remove(p)\n@tool\ndef a(u, p):\n    rm(u, p)\n", "auth.py": GATE},
    "not_gated": {"a.py": LC + "from auth import guard\nimport os\n@guard\ndef rm(u, p):\n    os.remove(p)\n@tool\ndef a(u, p):\n    rm(u, p)\n", "auth.py": PASS},
    "function_gate": {"a.py": LC + "import os\n@tool\ndef a(user, p):\n    if user != 'root':\n        raise PermissionError('no')\n    os.remove(p)\n@tool\ndef b(n, p):\n    if n < 0:\n        raise ValueError('no')\n    os.remove(p)\n"},
    "broken": {"a.py": "def f(:\n", "b.rb": "puts 1", "c.py": "", "d.py": None},
    "lone_tool": {"a.py": LC + "import mystery\n@tool\ndef think(x):\n    return mystery.ponder(x)\n"},
    "class_tool": {"a.py": "from langchain.tools import BaseTool\nimport os\nclass Eraser(BaseTool):\n    def _run(self, p):\n        self.go(p)\n    def go(self, p):\n        os.remove(p)\n"},
    "inherited": {"a.py": LC + "from base import Worker\nclass Own(Worker):\n    pass\n@tool\ndef t(p):\n    w = Own()\n    w.wipe(p)\n", "base.py": "import shutil\nclass Worker:\n    def wipe(self, p):\n        shutil.rmtree(p)\n"},
    "cycle": {"a.py": LC + "import os\ndef x(p):\n    y(p)\ndef y(p):\n    x(p)\n    os.remove(p)\na = b\nb = a\n@tool\ndef t(p):\n    x(p)\n    a(p)\n"},
    "relative": {"pkg/sub/a.py": LC + "from ..util.fs import wipe as w\nfrom . import near\n@tool\ndef t(p):\n    w(p)\n    near.ping(p)\n", "pkg/util/fs.py": "import shutil\ndef wipe(p):\n    shutil.rmtree(p)\n", "pkg/sub/near.py": "import requests\ndef ping(u):\n    requests.get(u)\n"},
    "package": {"a.py": LC + "from lib import wipe\n@tool\ndef t(p):\n    wipe(p)\n", "lib/__init__.py": "from lib.impl import wipe\n", "lib/impl.py": "import shutil\ndef wipe(p):\n    shutil.rmtree(p)\n"},
    "crewai": {"a.py": "from crewai import Agent\nimport subprocess\ndef sh(c):\n    subprocess.run(c)\nw = Agent(role='x', tools=[sh])\n"},
    "frameworks": {
        "a.py": "from smolagents import CodeAgent\nfrom pydantic_ai import Agent\nfrom llama_index.core.tools import FunctionTool\nfrom langchain_openai import ChatOpenAI\nfrom haystack import Pipeline\nimport os\ndef f1(p):\n    os.remove(p)\ndef f2(p):\n    os.remove(p)\ndef f3(p):\n    os.remove(p)\ndef f4(p):\n    os.remove(p)\ndef f5(p):\n    os.remove(p)\nCodeAgent([f1])\nAgent('m', tools=[f2])\nFunctionTool.from_defaults(fn=f3)\nllm = ChatOpenAI()\nllm.bind_tools([f4])\npipe = Pipeline()\npipe.add_component('n', f5)\n",
        "b.py": "agent = object()\nimport os\n@agent.tool\ndef f6(p):\n    os.remove(p)\n",
    },
    "ts_relative": {"src/a.ts": "import { z } from 'openai';\nimport { wipe } from './lib/disk';\nexport async function clean(p: string) { await wipe(p); }\n", "src/lib/disk.ts": "import * as fs from 'fs';\nexport function wipe(p: string) { fs.rmSync(p); }\n"},
    "ts_package": {"apps/x/src/a.ts": "import { wipe } from '@acme/disk';\nimport { Tool } from '@langchain/core/tools';\nexport const clean = async (p) => { return wipe(p); };\n", "packages/disk/src/index.ts": "import { unlink } from 'node:fs';\nexport function wipe(p) { unlink(p); }\n"},
    "ts_later": {"a.ts": "import x from 'langchain';\nexport function go(c) { later(c); }\nfunction later(c) { eval(c); }\n"},
    "ts_plain": {"a.ts": "import fs from 'fs';\nexport function go(c) { fs.unlinkSync(c); }\nconst o = { run: (x) => eval(x) };\n"},
    "ts_mcp": {"a.ts": "import { McpServer } from '@modelcontextprotocol/sdk/server/mcp.js';\nimport axios from 'axios';\nconst server = new McpServer({ name: 's' });\nserver.tool('post', { u: 1 }, async ({ u }) => { await axios.post(u); });\n"},
    "ts_schema": {"a.ts": "import OpenAI from 'openai';\nimport { exec } from 'child_process';\nconst manifest = [{ function: { description: 'd', name: 'shell' }, type: 'function' }];\nfunction shell(cmd) { exec(cmd); }\nfunction other(cmd) { exec(cmd); }\n"},
    "ts_action": {"a.ts": "import { unlink } from 'fs';\nconst act: Action = { name: 'a', handler: async (rt, msg) => { unlink(msg.path); } };\nconst plain = { handler: (x) => { unlink(x); } };\n"},
    "ts_gate": {"a.ts": "import { Agent } from '@mastra/core';\nimport { rm } from 'fs/promises';\nexport async function erase(user, p) {\n  if (!user.admin) { throw new ForbiddenError('no'); }\n  await rm(p);\n}\n"},
    "ts_service": {"a.ts": "import { exec } from 'child_process';\nclass S extends BaseService {\n  async start(c) { this.go(c); }\n  go(c) { exec(c); }\n}\n"},
    "ts_vercel": {"a.ts": "import { tool } from 'ai';\nconst weather = tool({ description: 'd', execute: async ({ u }) => fetch(u) });\n"},
    "ts_register": {"a.js": "const { execSync } = require('child_process');\nfunction runIt(c) { execSync(c); }\nbot.registerCommand('run', runIt);\n"},
}


@pytest.fixture(scope="module")
def analysis(spark):
    rows = [(p, f, t) for p, fs in PROJECTS.items() for f, t in fs.items()]
    return exposure.analyse(files.from_sources(spark, rows))


@pytest.fixture(scope="module")
def events(analysis):
    out = {p: [] for p in PROJECTS}
    for e in analysis.events.orderBy("project", "file", "line", "tool").collect():
        out[e.project].append(e)
    return out


@pytest.mark.parametrize(
    ("project", "tool", "framework", "operation", "severity", "path"),
    [
        ("delete_elsewhere", "clean", "langchain", "shutil.rmtree", "critical", ["app/agent.py:clean", "app/disk.py:wipe"]),
        ("langgraph_list", "purge", "langgraph", "shutil.rmtree", "critical", ["t.py:purge"]),
        ("returned_bundle", "purge", "langgraph", "shutil.rmtree", "critical", ["t.py:purge"]),
        ("openai_manifest", "calc", "openai", "builtins.eval", "critical", ["t.py:calc"]),
        ("openai_helper", "calc", "openai", "builtins.eval", "critical", ["t.py:calc"]),
        ("autogen_map", "drop", "autogen", "os.remove", "critical", ["a.py:drop"]),
        ("extended_list", "outer", "langchain", "os.system", "critical", ["a.py:outer", "a.py:inner"]),
        ("parent_mkdir", "mk", "langchain", "pathlib.Path.parent.mkdir", "warning", ["a.py:mk"]),
        ("dispatch", "do", "langchain", "shutil.rmtree", "critical", ["a.py:do", "a.py:rm"]),
        ("class_tool", "_run", "langchain", "os.remove", "critical", ["a.py:Eraser._run", "a.py:Eraser.go"]),
        ("inherited", "t", "langchain", "shutil.rmtree", "critical", ["a.py:t", "base.py:Worker.wipe"]),
        ("cycle", "t", "langchain", "os.remove", "critical", ["a.py:t", "a.py:x", "a.py:y"]),
        ("package", "t", "langchain", "shutil.rmtree", "critical", ["a.py:t", "lib/impl.py:wipe"]),
        ("crewai", "sh", "crewai", "subprocess.run", "critical", ["a.py:sh"]),
        ("ts_relative", "clean", "export-entry", "fs.rmSync", "critical", ["src/a.ts:clean", "src/lib/disk.ts:wipe"]),
        ("ts_package", "clean", "export-entry", "fs.unlink", "critical", ["apps/x/src/a.ts:clean", "packages/disk/src/index.ts:wipe"]),
        ("ts_later", "go", "export-entry", "eval", "critical", ["a.ts:go", "a.ts:later"]),
        ("ts_mcp", "post", "mcp", "axios.post", "warning", ["a.ts:post"]),
        ("ts_schema", "shell", "openai", "child_process.exec", "critical", ["a.ts:shell"]),
        ("ts_action", "act.handler", "action-object", "fs.unlink", "critical", ["a.ts:act.handler"]),
        ("ts_service", "start", "service-class", "child_process.exec", "critical", ["a.ts:S.start", "a.ts:S.go"]),
        ("ts_vercel", "weather.execute", "vercel-ai", "fetch", "warning", ["a.ts:weather.execute"]),
        ("ts_register", "runIt", "registration", "child_process.execSync", "critical", ["a.js:runIt"]),
    ],
)
def test_one_event(events, project, tool, framework, operation, severity, path):
    (e,) = events[project]
    assert (e.tool, e.framework, e.operation.split(": ")[1], e.severity, e.call_path) == (tool, framework, operation, severity, path)
    assert e.involves_cross_file == (len({p.split(":")[0] for p in path}) > 1)
    assert e.gate_status == "absent" and e.classification and e.evidence_kind != "heuristic" or project in ("ts_later", "ts_vercel")  # globals go by the callee's text


def reached(rows):
    return [(e.tool, e.operation.split(": ")[1], e.severity) for e in rows]


def test_several_operations(events):
    assert reached(events["sinks"]) == [("save", "pathlib.Path.write_text", "warning"), ("save", "requests.post", "warning")]
    assert reached(events["with_open"]) == [("log", "builtins.open", "warning"), ("log", "builtins.open.write", "warning")]
    assert ("mail", "smtplib.SMTP.sendmail", "warning") in reached(events["smtp_helper"])
    assert {o for _, o, _ in reached(events["database"])} == {"sqlite3.connect.cursor.execute", "redis.Redis.set"}
    assert reached(events["open_modes"]) == [("w", "builtins.open", "warning"), ("r", "builtins.open", "info")]
    assert {t for t, *_ in reached(events["two_tools"])} == {"a", "b"} and len(events["two_tools"]) == 2
    assert {(e.operation.split(": ")[1], tuple(e.call_path)) for e in events["relative"]} == {("shutil.rmtree", ("pkg/sub/a.py:t", "pkg/util/fs.py:wipe")), ("requests.get", ("pkg/sub/a.py:t", "pkg/sub/near.py:ping"))}


def test_every_framework(events):
    assert {e.tool: e.framework for e in events["frameworks"]} == {"f1": "smolagents", "f2": "pydantic-ai", "f3": "llama-index", "f4": "langgraph", "f5": "haystack", "f6": "pydantic-ai"}


def test_no_root_no_event(events):
    assert events["own_decorator"] == [] and events["ts_plain"] == []


def test_input_is_followed(events):
    kinds = {e.tool: (e.evidence_kind, e.confidence) for e in events["input_flow"] + events["flow_by_call"]}
    assert {k: v[0] for k, v in kinds.items()} == {"drop": "structural", "fixed": "semantic", "yes": "structural", "no": "semantic"}
    assert kinds["drop"][1] > 0.85


def test_gates(analysis, events):
    gates = {(p, e.tool): e.gate_status for p in ("gated", "not_gated", "function_gate", "ts_gate") for e in events[p]}
    assert gates == {("gated", "a"): "present", ("not_gated", "a"): "absent", ("function_gate", "a"): "present", ("function_gate", "b"): "absent", ("ts_gate", "erase"): "present"}
    found = {(r.project, r.tool) for r in analysis.findings.select("project", "tool").collect()}
    assert ("gated", "a") not in found and ("not_gated", "a") in found and ("ts_gate", "erase") not in found


def test_a_tool_without_operations(events):
    (e,) = events["lone_tool"]
    assert (e.operation, e.severity, e.classification, e.unresolved_calls) == ("Agent tool registration: think", "info", None, ["mystery.ponder"])


def test_files_that_fail(analysis):
    rows = {r.file: (r.language, r.error, r.skipped) for r in analysis.files.where("project = 'broken'").collect()}
    assert rows["a.py"][1].startswith("Syntax error") and rows["b.rb"] == (None, "Unsupported file type", True)
    assert rows["c.py"] == ("python", None, False) and rows["d.py"] == ("python", "Could not read file", False)


def test_properties(analysis):
    rows = analysis.events.collect()
    key = [(e.project, e.tool_file, e.tool, e.file, e.line, e.operation) for e in rows if e.language == "python"]
    assert len(key) == len(set(key))
    assert all(len(set(e.call_path)) == len(e.call_path) <= 20 and 0.45 <= e.confidence <= 0.98 for e in rows)
    assert analysis.findings.count() == sum(e.gate_status == "absent" and e.classification is not None for e in rows)


def test_no_files(spark):
    a = exposure.analyse(files.from_sources(spark, [("p", "x.rb", "")]))
    assert a.events.count() == 0 and a.files.count() == 1
