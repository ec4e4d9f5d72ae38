"""Entry points and sources of frameworks, as filters, joins and closures over rows of functions (see ``frontend.functions``), calls and routes of any front end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph

# Names that frameworks give.
VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "route", "websocket")
FLASK = ("route", "get", "post", "put", "delete", "patch")
HOOKS = ("before_request", "before_first_request", "before_app_request")
TOOLS = ("tool", "call_tool")
VIEW_METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
FLASK_VIEWS = ("View", "MethodView", "Resource")
HTTP_BASES = ("BaseHTTPRequestHandler", "SimpleHTTPRequestHandler", "CGIHTTPRequestHandler", "BaseRequestHandler", "StreamRequestHandler")
TORNADO = ("RequestHandler", "WebSocketHandler")
INFERENCE = (("UserHandler", "MayaBaseHandler", "predict_np"), ("TritonPythonModel", None, "execute"))
# Default sources. Language, receiver type, how the value comes (field, argument, return), names.
GIN_FIELDS = ("Params", "Accepted", "Request", "BindQuery")
GIN_ARGUMENTS = tuple("BindJSON BindYAML BindXML BindUri MustBindWith Bind BindHeader BindWith BindQuery ShouldBind ShouldBindBodyWith ShouldBindJSON ShouldBindUri ShouldBindHeader ShouldBindWith ShouldBindQuery ShouldBindXML ShouldBindYAML".split())
GIN_RETURNS = tuple("FullPath GetHeader QueryArray Query PostFormArray PostForm Param GetStringSlice GetString GetRawData ClientIP ContentType Cookie GetQueryArray GetQuery GetPostFormArray GetPostForm DefaultPostForm DefaultQuery GetPostFormMap GetQueryMap GetStringMap GetStringMapString GetStringMapStringSlice PostFormMap QueryMap".split())
PHP_GLOBALS = ("_GET", "_POST", "_REQUEST", "_COOKIE", "_SERVER", "_FILES")
PHP_GETTERS = ("getRequest", "getPost", "getQuery", "getCookie", "getHeader", "getEnv", "getUnSafeData", "getAllRequest", "getAllGetAndPost", "input", "param")
EGG_FIELDS = ("ctx.query", "ctx.queries", "ctx.params", "ctx.request", "this.ctx.query", "this.ctx.queries", "this.ctx.params", "this.ctx.request")
DEFAULT_SOURCES = (
    ("go", "*gin.Context", "field", GIN_FIELDS), ("go", "*gin.Context", "argument", GIN_ARGUMENTS), ("go", "*gin.Context", "return", GIN_RETURNS),
    ("go", "*http.Request", "field", ("URL",)), ("go", "*http.Request", "return", ("FormValue", "PostFormValue")), ("go", "*url.URL", "return", ("Query",)), ("go", "url.Values", "return", ("Get",)),
    ("php", "", "field", PHP_GLOBALS), ("php", "", "return", ("readline",)), ("php", "*", "return", PHP_GETTERS), ("javascript", "", "field", EGG_FIELDS),
)
GIN_ROUTES, GIN_ROUTERS = ("POST", "GET", "DELETE", "PUT", "Handle", "Use"), ("gin.Default()", "gin.New()")
EGG_VERBS = ("head", "options", "get", "post", "delete", "put", "patch", "del", "redirect", "rpcAndGet", "rpcAndPost")
PHP_CONTROLLER, PHP_BASES = "controller", ("basecontroller", "controller")
PHP_BUCKETS, PHP_BUCKET_BASES = ("databucket", "databacket", "databuck", "bucket"), ("basedatabucket", "databucket", "basedatabacket", "databacket")
PHP_MAGIC = tuple("__construct __destruct __get __set __call __callStatic __isset __unset __sleep __wakeup __toString __invoke __clone __debugInfo __serialize __unserialize".split())
PHP_TEMPLATES = ("setinstance", "getinstance")
DEPTH = 10


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _some(test) -> Column:
    return F.exists("decorators", test)


def _points(rows: DataFrame, framework: str, attribute: str) -> DataFrame:
    return rows.where("func_name is not null").select("file", "class_name", "func_name", "start_line", "end_line", F.lit(framework).alias("framework"), F.lit(attribute).alias("attribute")).distinct()


def fastapi(functions: DataFrame, assigns: DataFrame) -> DataFrame:
    """Functions decorated by a verb of a router of their file. assigns: file, var, callee - what variables were made by; routers come from fastapi's names."""
    routers = assigns.where(F.startswith("callee", F.lit("fastapi")) | _last(F.col("callee")).isin("FastAPI", "APIRouter")).select("file", F.col("var").alias("router")).distinct()
    each = functions.select("*", F.explode("decorators").alias("d")).where(F.col("d.call") & _last(F.col("d.name")).isin(*VERBS)).withColumn("router", F.regexp_replace("d.name", r"\.[^.]*$", ""))
    return _points(each.join(routers, ["file", "router"], "left_semi"), "fastapi", "HTTP")


def flask_routes(functions: DataFrame) -> DataFrame:
    """The receiver isn't looked at; ``patch`` needs a first argument that starts with a slash, for it is also a test helper."""
    hit = _some(lambda d: d["call"] & d["name"].contains(".") & F.substring_index(d["name"], ".", -1).isin(*FLASK) & ((F.substring_index(d["name"], ".", -1) != "patch") | F.coalesce(F.startswith(d["first"], F.lit("/")), F.lit(False))))
    return _points(functions.where(hit), "flask", "HTTP")


def flask_hooks(functions: DataFrame) -> DataFrame:
    return _points(functions.where(_some(lambda d: F.substring_index(d["name"], ".", -1).isin(*HOOKS))), "flask", "HOOK")


def mcp_tools(functions: DataFrame) -> DataFrame:
    return _points(functions.where(_some(lambda d: d["call"] & F.substring_index(d["name"], ".", -1).isin(*TOOLS))), "mcp", "MCPTool")


def inheriting(functions: DataFrame, bases: tuple[str, ...]) -> DataFrame:
    """Methods of classes that inherit one of ``bases`` by simple name, in at most ten steps."""
    edges = functions.where("class_name is not null").select(F.col("class_name").alias("src"), F.explode("bases").alias("b")).select("src", _last(F.col("b")).alias("dst")).distinct()
    good = graph.closure(edges, depth=DEPTH).where(F.col("dst").isin(*bases)).select(F.col("src").alias("class_name")).distinct()
    return functions.join(good, "class_name", "left_semi")


def flask_views(functions: DataFrame) -> DataFrame:
    return _points(inheriting(functions, FLASK_VIEWS).where(F.col("func_name").isin(*VIEW_METHODS, "dispatch_request")), "flask", "VIEW")


def http_server(functions: DataFrame) -> DataFrame:
    return _points(inheriting(functions, HTTP_BASES).where(F.startswith("func_name", F.lit("do_")) | (F.col("func_name") == "handle")), "http.server", "HTTP")


def tornado(functions: DataFrame) -> DataFrame:
    return _points(inheriting(functions, TORNADO).where(F.col("func_name").isin(*VIEW_METHODS, "on_message", "prepare")), "tornado", "HTTP")


def inference(functions: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for owner, base, method in INFERENCE:
        one = (F.col("class_name") == owner) & (F.col("func_name") == method)
        hit = hit | (one if base is None else one & F.exists("bases", lambda b, base=base: F.substring_index(b, ".", -1) == base))
    return _points(functions.where(hit), "inference", "HANDLER")


def mains(functions: DataFrame) -> DataFrame:
    return _points(functions.where("func_name = 'main'"), "main", "MAIN")


def annotated(functions: DataFrame, mark: str = "Mapping") -> DataFrame:
    """Functions with a modifier that holds ``mark``, as mapping annotations do. functions: modifiers array<string>."""
    return functions.where(F.exists("modifiers", lambda m: m.contains(mark)))


def uncalled(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions whose simple name nothing calls: the file-level entry points of a call graph."""
    called = calls.select(_last(F.col("callee")).alias("func_name")).distinct()
    return functions.where("func_name is not null").join(called, "func_name", "left_anti")


def default_sources(spark: SparkSession, language: str | None = None) -> DataFrame:
    """language, callee_type, how, name, kind of the sources that a language's frameworks have by default."""
    rows = [(lang, owner, how, n, "GO_INPUT" if lang == "go" else "INPUT") for lang, owner, how, names in DEFAULT_SOURCES for n in names if language in (None, lang)]
    return spark.createDataFrame(rows, "language string, callee_type string, how string, name string, kind string")


def sourced(uses: DataFrame, sources: DataFrame) -> DataFrame:
    """uses (language, callee_type, how, name, ...) that are sources, with their kind. ``*`` is any receiver type, no type is that of a global name."""
    s = sources.select("language", "how", "name", F.col("callee_type").alias("_type"), "kind")
    return uses.join(s, ["language", "how", "name"]).where((F.col("_type") == "*") | (F.coalesce("callee_type", F.lit("")) == F.col("_type"))).drop("_type").distinct()


def gin_routes(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions that are handed to a route call of a gin engine. calls: file, receiver (what made it), method, args (names)."""
    hit = calls.where(F.col("method").isin(*GIN_ROUTES) & (F.greatest(*(F.instr("receiver", r) for r in GIN_ROUTERS)) > 0))
    names = hit.select(F.explode("args").alias("a")).select(_last(F.col("a")).alias("func_name")).distinct()
    return _points(functions.join(names, "func_name", "left_semi"), "gin", "HTTP")


def egg_routes(routes: DataFrame, methods: DataFrame) -> DataFrame:
    """Controller methods that a router's verb names. routes: file, verb, action (controller.path.method); methods: file, class_name, func_name, start_line, end_line.

    The action's names, without its method, are the controller's path from its end, whatever the case and the file's dashes and underscores; static files under /app/public are none.
    """
    public = lambda c: F.contains(F.col(c), F.lit("/app/public"))
    parts = F.split("action", r"\.")
    r = routes.where(F.col("verb").isin(*EGG_VERBS) & ~public("file") & (F.size(parts) > 1)).select(F.element_at(parts, -1).alias("func_name"), F.lower(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).alias("_path")).distinct()
    m = methods.where(~public("file")).withColumn("_file", F.lower(F.regexp_replace(F.regexp_replace("file", r"\.[^./]*$", ""), "[_-]", "")))
    hit = m.join(r, "func_name").where((F.col("_file") == F.col("_path")) | F.endswith("_file", F.concat(F.lit("/"), F.col("_path"))))
    return _points(hit.withColumn("file", F.regexp_replace("file", "^.*?(?=/app/)", "")), "egg", "HTTP")


def _php(functions: DataFrame, ends: tuple[str, ...], bases: tuple[str, ...], least_params: int, framework: str) -> DataFrame:
    lower = functions.where("class_name is not null").withColumn("_class", F.lower("class_name"))
    edges = lower.select(F.col("_class").alias("src"), F.explode("bases").alias("b")).select("src", F.lower(_last(F.regexp_replace("b", r"\\\\", "."))).alias("dst")).distinct()
    heirs = graph.closure(edges, depth=DEPTH).where(F.col("dst").isin(*bases)).select(F.col("src").alias("_class")).distinct()
    own = F.lit(False)
    for e in ends:
        own = own | F.endswith("_class", F.lit(e))
    named = lower.where(own).select("_class").distinct()
    hidden = F.exists(F.coalesce("modifiers", F.array()), lambda m: F.lower(m).isin("private", "protected", "abstract"))
    good = ~hidden & ~F.col("func_name").isin(*PHP_MAGIC) & ~F.lower("func_name").isin(*PHP_TEMPLATES) & (F.coalesce("n_params", F.lit(0)) >= least_params)
    return _points(lower.join(heirs.union(named).distinct(), "_class", "left_semi").where(good & ~F.col("_class").isin(*bases)), framework, framework)


def php_controllers(functions: DataFrame) -> DataFrame:
    """Public methods with a parameter of classes named or inheriting a controller, but for magic and template ones. functions: class_name, bases, func_name, modifiers, n_params."""
    return _php(functions, (PHP_CONTROLLER,), PHP_BASES, 1, "CustomMvcController")


def php_buckets(functions: DataFrame) -> DataFrame:
    """Public methods of data-bucket classes, by name or base."""
    return _php(functions, PHP_BUCKETS, PHP_BUCKET_BASES, 0, "CustomDataBucket")


def lifespans(functions: DataFrame, apps: DataFrame) -> DataFrame:
    """Functions passed as ``lifespan`` to an app of their file. apps: file, lifespan."""
    return _points(functions.join(apps.where("lifespan is not null").select("file", _last(F.col("lifespan")).alias("func_name")).distinct(), ["file", "func_name"], "left_semi"), "fastapi", "LIFESPAN")
