"""What surrounds a function, in one line: its file, class, imports, purpose, calls and callers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename

# The words of the summaries.
FILE, CLASS, IMPORTS, CALLS, USE, PURPOSE, CONFIG = "文件: ", "类: ", "导入: ", "调用: ", "使用: ", "用途: ", "配置: "
ALONE, ALONE_WITHOUT_CONTEXT = "独立函数", "独立函数，无特殊上下文"
DOMAINS = {
    "transformers": "AI模型处理", "torch": "深度学习框架", "tensorflow": "机器学习框架", "sklearn": "机器学习工具", "huggingface": "AI模型库",
    "datasets": "数据管理", "tokenizers": "文本预处理", "flask": "Web服务", "django": "Web应用框架", "fastapi": "API服务", "requests": "网络通信",
    "aiohttp": "异步网络", "pandas": "数据分析", "numpy": "数值计算", "matplotlib": "图表绘制", "seaborn": "统计图表", "sqlalchemy": "数据库管理",
    "pymongo": "文档数据库", "redis": "缓存服务", "logging": "日志管理", "json": "数据格式", "os": "系统接口", "pathlib": "文件路径",
}
FUNCTION_PATTERNS = {
    "download": "资源下载", "load": "数据加载", "save": "数据保存", "train": "模型训练", "predict": "模型预测", "transform": "数据转换",
    "process": "数据处理", "validate": "数据验证", "parse": "数据解析", "encode": "数据编码", "decode": "数据解码", "generate": "内容生成",
    "create": "对象创建", "build": "构建操作", "setup": "环境配置", "init": "初始化", "configure": "参数配置",
}
API_NAMES = {
    "from_pretrained": "预训练模型加载", "pipeline": "AI任务流水线", "model": "AI模型操作", "tokenizer": "文本分词", "huggingface": "AI模型库",
    "transformers": "AI模型处理", "hf_hub": "模型仓库", "snapshot_download": "模型下载", "download": "模型下载", "cache_dir": "模型缓存",
    "local_files_only": "本地模型", "get": "数据获取", "post": "数据提交", "put": "数据更新", "delete": "数据删除", "request": "网络请求",
    "fetch": "数据获取", "client": "API客户端", "session": "会话管理", "auth": "身份验证", "token": "访问令牌", "api_key": "API密钥",
    "endpoint": "服务端点", "base_url": "基础URL", "read": "文件读取", "write": "文件写入", "open": "文件打开", "close": "文件关闭",
}
API_CALLS = {"get": "数据获取", "post": "数据提交", "put": "数据更新", "delete": "数据删除", "create": "创建操作", "update": "更新操作", "find": "查找操作", "search": "搜索操作"}
MODEL_LIBRARIES = ("huggingface", "transformers", "hf_hub", "datasets")
# Purpose by words, the first that holds; the last has no words and holds always.
MODEL_CLIENT = ((("api_key", "token", "auth"), "配置AI模型服务连接"), (("base_url", "endpoint", "url"), "建立模型仓库连接"), ((), "初始化AI模型客户端"))
MODEL_BY_NAME = (
    (("download", "fetch"), "下载AI模型文件"), (("load", "from_pretrained"), "加载预训练模型"), (("cache",), "管理模型缓存"), (("tokenizer",), "文本预处理"), (("pipeline",), "创建AI任务流水线"),
)
MODEL_BY_CODE = (
    (("from_pretrained", "pipeline"), "AI模型操作"), (("download", "snapshot_download"), "模型文件下载"), (("tokenizer", "tokenize"), "文本预处理"),
    (("cache", "cache_dir"), "模型缓存管理"), (("client", "hub", "api_key"), "模型服务连接"), ((), "AI模型操作"),
)
MODEL_DOMAIN = (
    (("from_pretrained", "pipeline"), "AI模型加载"), (("download", "snapshot_download"), "模型文件下载"), (("tokenizer", "tokenize"), "文本预处理"),
    (("cache", "cache_dir"), "模型缓存管理"), (("client", "hub"), "模型仓库连接"), ((), "AI模型操作"),
)
NETWORK_DOMAIN = ((("get", "post", "put", "delete"), "API数据交互"), (("client", "session"), "网络连接管理"), (("auth", "token", "api_key"), "身份认证"), ((), "网络通信"))
MODEL_CALLS = (("from_pretrained",), "预训练模型加载"), (("pipeline",), "AI任务流水线"), (("download",), "模型文件下载"), (("tokenizer",), "AI模型操作")


def _holds(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _first(text: Column, table: dict[str, str]) -> Column:
    """The value of the first key that a text has in it, in the order of the table; null if none."""
    chain = F
    for key, value in table.items():
        chain = chain.when(F.contains(text, F.lit(key)), value)
    return chain.otherwise(F.lit(None).cast("string"))


def _rule(text: Column, rules: Sequence[tuple[tuple[str, ...], str]], hit=None) -> Column:
    """The purpose of the first rule that has a word in the text; null if none."""
    chain = F
    for words, purpose in rules:
        chain = chain.when((hit or _holds)(text, words) if words else F.lit(True), F.lit(PURPOSE + purpose))
    return chain.otherwise(F.lit(None).cast("string"))


def _any(array: Column, words: Iterable[str]) -> Column:
    return F.coalesce(F.exists(array, lambda x: _holds(F.lower(x), words)), F.lit(False))


def _place(path: Column, parent_class: Column) -> list[Column]:
    named = lambda label, x: F.when(x != "", F.concat(F.lit(label), x))
    return [named(FILE, basename(path)), named(CLASS, parent_class)]


def _some(label: str, array: Column, most: int) -> Column:
    return F.when(F.size(array) > 0, F.concat(F.lit(label), F.array_join(F.slice(array, 1, most), ", ")))


def _joined(parts: list[Column], empty: str) -> Column:
    line = F.concat_ws(" | ", *parts)
    return F.when(line == "", empty).otherwise(line)


def fast_summary(path: Column, parent_class: Column, imports: Column) -> Column:
    """File, class and the first two imports; what is null or empty is left out."""
    return _joined([*_place(path, parent_class), _some(IMPORTS, imports, 2)], ALONE)


def fallback_summary(path: Column, parent_class: Column, imports: Column, n_calls: Column) -> Column:
    """File, class, the first three imports and the number of calls."""
    calls = F.when(n_calls > 0, F.concat(F.lit(CALLS), n_calls.cast("string"), F.lit("个函数")))
    return _joined([*_place(path, parent_class), _some(IMPORTS, imports, 3), calls], ALONE_WITHOUT_CONTEXT)


def model_purpose(name: Column, code: Column, imports: Column) -> Column:
    """Purpose of a function of a file that imports a model library; null for others."""
    name, code = F.lower(name), F.lower(code)
    client = F.when(_holds(name, ("client", "init")), _rule(code, MODEL_CLIENT))
    return F.when(_any(imports, MODEL_LIBRARIES), F.coalesce(client, _rule(name, MODEL_BY_NAME), _rule(code, MODEL_BY_CODE)))


def domain_purpose(imports: Column, calls: Column, name: Column) -> Column:
    """Purpose by the libraries and words that imports, calls and the name have in them; null if none is known.

    Domains count in the order in which they are found: imports, calls, the name.
    """
    name = F.lower(name)
    tags = lambda array: F.transform(F.coalesce(array, F.array().cast("array<string>")), lambda x: _first(F.lower(x), DOMAINS))
    found = F.concat(tags(imports), tags(calls), F.array(_first(name, FUNCTION_PATTERNS), _first(name, API_NAMES)))
    found = F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, F.coalesce(
        F.when(_any(imports, MODEL_LIBRARIES), _rule(name, MODEL_DOMAIN)),
        F.when(_any(imports, ("requests", "aiohttp")), _rule(name, NETWORK_DOMAIN)),
        _rule(calls, MODEL_CALLS, _any),
        F.concat(F.lit(PURPOSE), F.array_join(F.slice(found, 1, 2), ", ")),
    ))


def call_pattern(calls: Column) -> Column:
    """What the first call with a known word does, else the number of calls; null without calls."""
    known = F.get(F.filter(F.transform(calls, lambda x: _first(F.lower(x), API_CALLS)), lambda x: x.isNotNull()), F.lit(0))
    counted = F.concat(F.size(calls).cast("string"), F.lit("个函数"), F.when(F.size(calls) > 3, "（复杂调用）").otherwise(""))
    return F.when(F.size(calls) > 0, F.concat(F.lit(CALLS), F.coalesce(known, counted)))


def usage_breadth(n_files: Column) -> Column:
    """How many files call a function; null if none does."""
    many = F.concat(F.lit(USE), n_files.cast("string"), F.lit("个文件调用"), F.when(n_files > 3, "（广泛使用）").otherwise(""))
    return F.when(n_files == 1, F.lit(USE + "单文件内调用")).when(n_files > 1, many)


def config_kinds(kinds: Column) -> Column:
    """Which of config_item and constant_definition an array of kinds has, in this order; null if neither."""
    has = lambda kind, label: F.when(F.array_contains(kinds, kind), F.lit(label))
    line = F.concat_ws(", ", has("config_item", "配置项"), has("constant_definition", "常量"))
    return F.when(line != "", F.concat(F.lit(CONFIG), line))


def full_summary(path: Column, parent_class: Column, name: Column, code: Column, imports: Column, calls: Column, n_files: Column, kinds: Column | None = None) -> Column:
    """File, class, purpose, call pattern, usage and configuration. calls: names; n_files: files that call the function."""
    purpose = F.coalesce(model_purpose(name, code, imports), domain_purpose(imports, calls, name))
    more = [config_kinds(kinds)] if kinds is not None else []
    return _joined([*_place(path, parent_class), purpose, call_pattern(calls), usage_breadth(n_files), *more], ALONE_WITHOUT_CONTEXT)


def search_description(row: dict[str, Column]) -> Column:
    """The text by which a function is searched. row: name, description, args, returns, context, level, code; those missing or empty are left out."""
    # Labels of the parts
    labels = {"name": "函数名: ", "description": "描述: ", "args": "参数: ", "returns": "返回值: ", "context": "上下文: ", "level": "复杂度: ", "code": "代码: "}
    if "code" in row:
        code = row["code"]
        row = row | {"code": F.when(F.length(code) > 100, F.concat(F.substring(code, 1, 100), F.lit("..."))).otherwise(code)}
    return F.concat_ws(" | ", *[F.when(row[k] != "", F.concat(F.lit(label), row[k])) for k, label in labels.items() if k in row])


# Fields of a result's context and what stands in for a missing one.
RESULT_DEFAULTS = {
    "function_name": "Unknown", "file_path": "Unknown", "language": "unknown", "function_type": "regular", "complexity_score": 0.0, "start_line": 0, "end_line": 0,
    "docstring": "", "parameters_count": 0, "return_type": "", "parent_class": "", "is_async": False, "is_test": False, "is_decorator": False,
}


def result_context(row: dict[str, Column]) -> Column:
    """STRUCT of the fields of a search result, each with its default where it is missing or null."""
    return F.struct(*[F.coalesce(row[k], F.lit(v)).alias(k) if k in row else F.lit(v).alias(k) for k, v in RESULT_DEFAULTS.items()])
