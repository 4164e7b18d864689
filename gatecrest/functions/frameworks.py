"""What registers a function as an agent's tool, as data."""

#: Of a call whose callee is known by this identity: the keyword and position of the argument that holds the tools (-1: keyword only), and the framework. The first that matches counts.
PYTHON_CALLS = (
    (r"(^|[.])langgraph[.]prebuilt[.]create_react_agent$", "tools", 1, "langgraph"),
    (r"(^|[.])langchain[.]agents[.](create_tool_calling_agent|AgentExecutor)$", "tools", 1, "langchain"),
    (r"(^|[.])smolagents[.](CodeAgent|ToolCallingAgent)$", "tools", 0, "smolagents"),
    (r"(^|[.])crewai[.]Agent$", "tools", -1, "crewai"),
    (r"(^|[.])autogen[.]UserProxyAgent([.]register_function)?$", "function_map", -1, "autogen"),
    (r"(^|[.])langchain_openai[.]\w+[.]bind_tools$", "tools", 0, "langgraph"),
    (r"(^|[.])openai[.]\w+[.]chat[.]completions[.]create$", "tools", -1, "openai"),
    (r"(^|[.])pydantic[_-]ai[.]Agent$", "tools", 1, "pydantic-ai"),
    (r"llama_index.*[.]FunctionTool([.]\w+)*$", "fn", 0, "llama-index"),
    (r"llama_index.*[.]QueryEngineTool([.]\w+)*$", "query_engine", 0, "llama-index"),
    (r"autogen.*[.](AssistantAgent|ConversableAgent|Agent)$", "tools", -1, "autogen"),
    (r"autogen.*[.]FunctionTool$", "func", 0, "autogen"),
    (r"haystack.*[.]add_component$", "component", 1, "haystack"),
    (r"google[._]adk.*Agent\w*$", "tools", -1, "google-adk"),
    (r"(^|[.])(\w*agents\w*|swarm)([.]\w+)*[.](Agent|function_to_schema)$", "tools", 0, "openai-agents"),
)
#: Of a decorator imported under this module and name: the framework; any other import called ``tool`` counts for its first module.
PYTHON_DECORATORS = (
    (r"^langchain(_core)?[.]tools[.]tool$", "langchain"),
    (r"^crewai[.]tools[.]tool$", "crewai"),
    (r"(^|[.])smolagents[.]tool$", "smolagents"),
    (r"(^|[.])pydantic[_-]ai[.]tool$", "pydantic-ai"),
    (r"autogen.*[.]tool$", "autogen"),
    (r"llama_index.*[.]tool$", "llama-index"),
    (r"haystack.*[.]component$", "haystack"),
)
TOOL_BASES = ("Action", "AgentAction", "AgentState", "AgentStep", "BaseAction", "BaseAgent", "BaseAgentState", "BaseCommand", "BaseRole", "BaseTool", "BaseToolMixin", "BaseToolkit", "CodeAgent", "Command", "Component", "DynamicTool", "FunctionTool", "KernelFunction", "KernelPlugin", "PipelineTool", "QueryEngineTool", "Role", "RuntimeAction", "StructuredTool", "Tool", "Toolkit")
BASE_FRAMEWORK = {"BaseTool": "langchain", "StructuredTool": "langchain", "Tool": "langchain", "FunctionTool": "llama-index", "QueryEngineTool": "llama-index", "PipelineTool": "smolagents", "CodeAgent": "smolagents", "Component": "haystack"}
RUN_METHODS = ("__call__", "_arun", "_execute", "_run", "ainvoke", "arun", "call", "execute", "perform", "run")
BUILTINS = ("open", "eval", "exec", "compile", "__import__")
