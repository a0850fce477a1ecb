"""The extended code channels: sparse vectors of colours, layout, CSS values, names, semantics and script tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import features
from weftline.plans import similarity
from weftline.plans.views import FRAME, VIEW

KEYS = ", ".join(features.KEY)

#: Patterns of colours, units and functions in CSS.
HEX = r"#([0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3,4})\b"
RGB = r"(?i)rgba?\(\s*([\d.]+)\s*,\s*([\d.]+)\s*,\s*([\d.]+)"
HSL = r"(?i)hsla?\(\s*([\d.]+)\s*,\s*([\d.]+)%\s*,\s*([\d.]+)%"
UNITS = "px rem em vw vh vmin vmax % pt fr ch ex deg turn ms s".split()
FUNCTIONS = """calc clamp min max var env linear-gradient radial-gradient conic-gradient translate3?d? translatex translatey rotate scale skew matrix perspective
 rgb rgba hsl hsla blur brightness contrast drop-shadow url cubic-bezier repeat minmax fit-content""".split()
KEYWORDS = ["rgb(", "rgba(", "hsl(", "hsla(", "currentcolor", "transparent"]
#: Named colours.
NAMED = {
    "black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "orange": "ffa500", "purple": "800080",
    "gray": "808080", "grey": "808080", "silver": "c0c0c0", "navy": "000080", "teal": "008080", "gold": "ffd700", "pink": "ffc0cb", "cyan": "00ffff",
    "magenta": "ff00ff", "lime": "00ff00", "indigo": "4b0082", "violet": "ee82ee", "brown": "a52a2a", "maroon": "800000", "olive": "808000", "coral": "ff7f50",
    "salmon": "fa8072", "khaki": "f0e68c", "crimson": "dc143c", "skyblue": "87ceeb", "tomato": "ff6347", "slateblue": "6a5acd", "darkblue": "00008b",
    "lightblue": "add8e6", "steelblue": "4682b4", "dodgerblue": "1e90ff", "royalblue": "4169e1", "midnightblue": "191970",
}
#: Layout values and properties.
DISPLAY = "flex grid inline-flex inline-block inline-grid none block contents".split()
POSITION = "absolute fixed relative sticky static".split()
FLOAT = "left right".split()
AT_RULES = "@media @keyframes @supports".split()
PROPERTIES = """gap grid-template-columns grid-template-rows grid-template-areas flex-direction justify-content align-items align-content place-items aspect-ratio
 transition animation transform box-shadow""".split()
#: Words of JavaScript that are a category of their own.
JS_WORDS = """break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this
 throw try typeof var void while with yield let static async await of get set true false null undefined""".split()
#: The longest operators first.
JS_OPERATORS = [">>>=", "===", "!==", "**=", "<<=", ">>=", ">>>", "&&=", "||=", "??=", "...", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "=>", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**", "<<", ">>"]
STYLES = "bem camel kebab utility single other".split()


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?{}[]|()" else c for c in text)


JS_TOKEN = "|".join([
    r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\z)", r'"(?:\\[\s\S]|[^"\\])*(?:"|\z)', r"'(?:\\[\s\S]|[^'\\])*(?:'|\z)", r"`(?:\\[\s\S]|[^`\\])*(?:`|\z)",
    r"(?:[0-9]|\.[0-9])[0-9a-fA-FxXbBoO._eE+\-]*", r"[A-Za-z_$\x{80}-\x{ffff}][A-Za-z0-9_$\x{80}-\x{ffff}]*", *map(_escaped, JS_OPERATORS), r"[^\s]",
])


def duck(text: str) -> str:
    """A pattern as a literal of the oracle, whose view texts take braces for inputs."""
    return "'" + text.replace("'", "''") + "'"


def channel(name: str, vectors: str) -> None:
    """Cosine of the vectors (``token, value``) of each two slots of a batch."""
    similarity.cosine(name, vectors)


# the CSS of a card: style elements, then style attributes
_STYLE, _INLINE = r"(?is)<style\b[^>]*>(.*?)</style>", r'(?is)<[a-z][^>]*?\sstyle\s*=\s*"([^"]*)"'
FRAME("css_all", lambda s, d, cards: cards.select(*features.KEY, F.concat_ws("\n", F.array_join(_all("html", _STYLE, 1), "\n"), F.array_join(_all(_bare(), _INLINE, 1), "\n")).alias("css")),
  f"""SELECT {KEYS}, array_to_string(regexp_extract_all(html, {duck(_STYLE)}, 1), chr(10)) || chr(10) || array_to_string(regexp_extract_all(regexp_replace(html, {duck(features.RAW_TEXT)}, '', 'g'), {duck(_INLINE)}, 1), chr(10)) AS css FROM cards""", "cards")


def _all(column: str | Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def _bare() -> Column:
    return F.regexp_replace("html", features.RAW_TEXT, "")


def counted(name: str, patterns: list[tuple[str, str]], lower: bool) -> None:
    """A view with how often each pattern occurs in the CSS; none where it doesn't."""

    def frame(s, d, css: DataFrame) -> DataFrame:
        text = F.lower("css") if lower else F.col("css")
        each = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.regexp_count(text, F.lit(p)).cast("double").alias("value")) for t, p in patterns])).alias("x")
        return css.select(*features.KEY, each).select(*features.KEY, "x.token", "x.value").filter("value > 0")

    text = "lower(css)" if lower else "css"
    rows = " UNION ALL ".join(f"SELECT {KEYS}, {duck(t)} AS token, CAST(len(regexp_extract_all({text}, {duck(p)})) AS DOUBLE) AS value FROM css_all" for t, p in patterns)
    FRAME(name, frame, f"SELECT * FROM ({rows}) WHERE value > 0", "css_all")


# x-layout
counted("layout_values", [
    *[(f"{p}:{v}", rf"{p}\s*:\s*{v}\b") for p, values in (("display", DISPLAY), ("position", POSITION), ("float", FLOAT)) for v in values],
    *[(a, rf"{a}\b") for a in AT_RULES], *[(p, rf"\b{p}\s*:") for p in PROPERTIES],
], lower=True)
channel("x_layout_pairs", "layout_values")

# x-css-values
_UNIT = rf"-?\d*\.?\d+({'|'.join(UNITS)})\b"
_FUNCTION = rf"(?i)\b({'|'.join(FUNCTIONS)})\s*\("
counted("css_keywords", [("colfmt:" + k.replace("(", ""), _escaped(k)) for k in KEYWORDS], lower=True)
FRAME("css_units", lambda s, d, css, words: _css_units(css, words), f"""SELECT {KEYS}, token, CAST(count(*) AS DOUBLE) AS value FROM (
  SELECT {KEYS}, 'unit:' || lower(unnest(regexp_extract_all(css, {duck("(?i)(?:^|[^A-Za-z0-9_.])" + _UNIT)}, 1))) AS token FROM css_all
  UNION ALL SELECT {KEYS}, 'fn:' || lower(unnest(regexp_extract_all(css, {duck(_FUNCTION)}, 1))) FROM css_all
  UNION ALL SELECT {KEYS}, 'colfmt:hex' || length(unnest(regexp_extract_all(css, {duck(HEX)}, 1))) FROM css_all) GROUP BY ALL
  UNION ALL SELECT {KEYS}, token, value FROM css_keywords""", "css_all css_keywords")


def _css_units(css: DataFrame, words: DataFrame) -> DataFrame:
    one = lambda prefix, pattern, f=F.lower: css.select(*features.KEY, F.explode(_all("css", pattern, 1)).alias("v")).select(*features.KEY, F.concat(F.lit(prefix), f("v")).alias("token"))
    rows = one("unit:", r"(?i)(?<![\w.])" + _UNIT).union(one("fn:", _FUNCTION)).union(one("colfmt:hex", HEX, F.length))
    return rows.groupBy(*features.KEY, "token").agg(F.count(F.lit(1)).cast("double").alias("value")).unionByName(words)


channel("x_css_values_pairs", "css_units")

# c-css-prop: names before a colon in what a semicolon or a closing brace ends
_DECLARATION, _NAME = r"[^{};]*[;}]", r"^\s*(-{0,2}[A-Za-z_][A-Za-z0-9_-]*)\s*:"
FRAME("css_properties", lambda s, d, css: css.select(*features.KEY, F.explode(_all("css", _DECLARATION)).alias("v")).select(*features.KEY, F.lower(F.regexp_extract("v", _NAME, 1)).alias("token")).filter("token <> ''").groupBy(*features.KEY, "token").agg(F.count(F.lit(1)).cast("double").alias("value")),
  f"""SELECT {KEYS}, token, CAST(count(*) AS DOUBLE) AS value FROM (SELECT {KEYS}, lower(regexp_extract(v, {duck(_NAME)}, 1)) AS token FROM
  (SELECT {KEYS}, unnest(regexp_extract_all(css, {duck(_DECLARATION)})) AS v FROM css_text)) WHERE token <> '' GROUP BY ALL""", "css_text")
channel("c_css_prop_pairs", "css_properties")

# x-color: hue, saturation and lightness in buckets
FRAME("colors", lambda s, d, css, named: _colors(css, named), f"""SELECT {KEYS}, r / 255 AS r, g / 255 AS g, b / 255 AS b, n FROM (
  SELECT {KEYS}, CAST(('0x' || substr(v, 1, 2)) AS INT) AS r, CAST(('0x' || substr(v, 3, 2)) AS INT) AS g, CAST(('0x' || substr(v, 5, 2)) AS INT) AS b, n FROM (
    SELECT {KEYS}, CASE WHEN length(v) < 6 THEN v[1] || v[1] || v[2] || v[2] || v[3] || v[3] ELSE v END AS v, CAST(1 AS DOUBLE) AS n FROM (SELECT {KEYS}, unnest(regexp_extract_all(css, {duck(HEX)}, 1)) AS v FROM css_all)
    UNION ALL SELECT {KEYS}, split_part(token, ' ', 2), value FROM color_names)
  UNION ALL SELECT {KEYS}, least(255, CAST(floor(CAST(regexp_extract(v, {duck(RGB)}, 1) AS DOUBLE)) AS INT)), least(255, CAST(floor(CAST(regexp_extract(v, {duck(RGB)}, 2) AS DOUBLE)) AS INT)),
    least(255, CAST(floor(CAST(regexp_extract(v, {duck(RGB)}, 3) AS DOUBLE)) AS INT)), CAST(1 AS DOUBLE) FROM (SELECT {KEYS}, unnest(regexp_extract_all(css, {duck(RGB)})) AS v FROM css_all))""", "css_all color_names")
counted("color_names", [(f"{name} {value}", rf"[:\s(]{name}[;\s)!,]") for name, value in NAMED.items()], lower=True)


def _colors(css: DataFrame, named: DataFrame) -> DataFrame:
    part = lambda i: F.conv(F.substring("v", i, 2), 16, 10).cast("int")
    double = F.concat(*[F.substring("v", i, 1) for i in (1, 1, 2, 2, 3, 3)])
    hexes = css.select(*features.KEY, F.explode(_all("css", HEX, 1)).alias("v")).withColumn("v", F.when(F.length("v") < 6, double).otherwise(F.col("v"))).withColumn("n", F.lit(1.0))
    hexes = hexes.unionByName(named.select(*features.KEY, F.split_part("token", F.lit(" "), F.lit(2)).alias("v"), F.col("value").alias("n")))
    value = lambda i: F.least(F.lit(255), F.floor(F.regexp_extract("v", RGB, i).cast("double")).cast("int"))
    calls = css.select(*features.KEY, F.explode(_all("css", RGB)).alias("v"))
    both = hexes.select(*features.KEY, part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), "n").union(calls.select(*features.KEY, value(1), value(2), value(3), F.lit(1.0)))
    return both.select(*features.KEY, *[(F.col(c) / 255).alias(c) for c in "rgb"], "n")


_HSL_PARTS = ", ".join(f"CAST(regexp_extract(v, {duck(HSL)}, {i}) AS DOUBLE){' / 100' if i > 1 else ''} AS {c}" for i, c in enumerate("hsl", 1))
FRAME("hsl_calls", lambda s, d, css: css.select(*features.KEY, F.explode(_all("css", HSL)).alias("v")).select(*features.KEY, *[(F.regexp_extract("v", HSL, i).cast("double") / (1 if i == 1 else 100)).alias(c) for i, c in enumerate("hsl", 1)], F.lit(1.0).alias("n")),
  f"SELECT {KEYS}, {_HSL_PARTS}, CAST(1 AS DOUBLE) AS n FROM (SELECT {KEYS}, unnest(regexp_extract_all(css, {duck(HSL)})) AS v FROM css_all)", "css_all")
VIEW("colors_hsl", f"""SELECT {KEYS}, n, l, CASE WHEN d = 0 THEN CAST(0 AS DOUBLE) WHEN l > 0.5 THEN d / (2 - mx - mn) ELSE d / (mx + mn) END AS s,
  60 * CASE WHEN d = 0 THEN CAST(0 AS DOUBLE) WHEN mx = r THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS h
  FROM (SELECT *, (mx + mn) / 2 AS l, mx - mn AS d FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM {{colors}}) x) y""")
VIEW("color_buckets", f"""SELECT {KEYS}, CASE WHEN s < 0.12 OR l < 0.06 OR l > 0.94 THEN 'achr:' || CAST(CAST(least(2, floor(l * 3)) AS INT) AS STRING)
  ELSE 'h' || CAST(CAST(floor((h % 360) / 30) AS INT) AS STRING) || '_l' || CAST(CAST(least(2, floor(l * 3)) AS INT) AS STRING) END AS token, CAST(sum(n) AS DOUBLE) AS value
  FROM (SELECT {KEYS}, n, h, s, l FROM {{colors_hsl}} UNION ALL SELECT {KEYS}, n, h, s, l FROM {{hsl_calls}}) x GROUP BY 1, 2, 3, 4, 5""")
channel("x_color_pairs", "color_buckets")

# x-naming: all class tokens with repeats; an element without classes is a signal, a card without elements is none
_CLASS = r'(?is)<[a-z][^>]*?\sclass\s*=\s*"([^"]*)"'
FRAME("class_tokens", lambda s, d, cards: cards.select(*features.KEY, F.explode(_all(_bare(), _CLASS, 1)).alias("v")).select(*features.KEY, F.explode(F.split("v", r"\s+")).alias("c")).filter("c <> ''"),
  f"SELECT * FROM (SELECT {KEYS}, unnest(string_split_regex(v, '\\s+')) AS c FROM (SELECT {KEYS}, unnest(regexp_extract_all(regexp_replace(html, {duck(features.RAW_TEXT)}, '', 'g'), {duck(_CLASS)}, 1)) AS v FROM cards)) WHERE c <> ''", "cards")
FRAME("class_styles", lambda s, d, tokens: tokens.withColumn("style", naming(F.col("c"))), f"""SELECT {KEYS}, c, CASE WHEN contains(c, '__') OR contains(c, '--') THEN 'bem' WHEN regexp_matches(c, '[a-z][A-Z]') THEN 'camel'
  WHEN regexp_full_match(c, '[a-z0-9]+(-[a-z0-9]+)+') THEN CASE WHEN len(list_filter(string_split(c, '-'), lambda x: length(x) <= 3 OR regexp_full_match(x, '[0-9]+'))) > 0 THEN 'utility' ELSE 'kebab' END
  WHEN regexp_full_match(c, '[a-z0-9]+') THEN 'single' ELSE 'other' END AS style FROM class_tokens""", "class_tokens")


def naming(c: Column) -> Column:
    """The style of a class token: bem, camel, utility (a part of three signs or of digits), kebab, single or other."""
    short = F.exists(F.split(c, "-"), lambda x: (F.length(x) <= 3) | x.rlike(r"^\d+$"))
    dashed = F.when(short, "utility").otherwise("kebab")
    return F.when(c.contains("__") | c.contains("--"), "bem").when(c.rlike("[a-z][A-Z]"), "camel").when(c.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"), dashed).when(c.rlike("^[a-z0-9]+$"), "single").otherwise("other")


VIEW("element_counts", f"SELECT {KEYS}, count(*) AS elements FROM {{nodes}} GROUP BY {KEYS}")
VIEW("class_mix", f"""SELECT e.batch, e.config, e.config_ord, e.slot, e.elements, coalesce(c.n, 0) AS n, c.mean_len, c.kinds, {', '.join(f'c.{x}' for x in STYLES)} FROM {{element_counts}} e LEFT JOIN
  (SELECT slot, count(*) AS n, avg(length(c)) AS mean_len, count(DISTINCT c) AS kinds, {', '.join(f"sum(CASE WHEN style = '{x}' THEN 1 ELSE 0 END) AS {x}" for x in STYLES)} FROM {{class_styles}} GROUP BY slot) c ON e.slot = c.slot""")
_NAMING = [*[(f"style:{x}", f"{x} / n") for x in STYLES], ("class_density", "n / elements"), ("mean_len", "mean_len / 20"), ("uniq_ratio", "kinds / n")]
VIEW("naming_values", similarity.values("class_mix", [("noclass", "CASE WHEN n = 0 THEN 1 END"), *[(t, f"CASE WHEN n > 0 THEN {e} END") for t, e in _NAMING]], "value > 0"),
  f"SELECT {KEYS}, 'noclass' AS token, CAST(1 AS DOUBLE) AS value FROM {{class_mix}} WHERE n = 0 UNION ALL " + " UNION ALL ".join(
    f"SELECT {KEYS}, '{t}', CAST({e} AS DOUBLE) FROM {{class_mix}} WHERE n > 0 AND {e} > 0" for t, e in _NAMING))
channel("x_naming_pairs", "naming_values")

# x-semantics: fifteen ratios
_OPEN, _QUOTED = r"(?is)<[a-z][^>]*>", r"""(?s)"[^"]*"|'[^']*'"""
_ATTRIBUTES = {"aria": r"(?i)\saria-", "role": r"(?i)\srole[\s=>/]", "data_attr": r"(?i)\sdata-"}
FRAME("attribute_counts", lambda s, d, cards: cards.select(*features.KEY, F.regexp_replace(F.array_join(_all(_bare(), _OPEN), "\n"), _QUOTED, "").alias("t")).select("slot", *[F.regexp_count("t", F.lit(p)).alias(c) for c, p in _ATTRIBUTES.items()]),
  "SELECT slot, " + ", ".join(f"len(regexp_extract_all(t, {duck(p)})) AS {c}" for c, p in _ATTRIBUTES.items()) + f""" FROM
  (SELECT slot, regexp_replace(array_to_string(regexp_extract_all(regexp_replace(html, {duck(features.RAW_TEXT)}, '', 'g'), {duck(_OPEN)}), chr(10)), {duck(_QUOTED)}, '', 'g') AS t FROM cards)""", "cards")
_share = lambda *tags: f"sum(CASE WHEN tag IN ({', '.join(repr(t) for t in tags)}) THEN 1 ELSE 0 END) / count(*)"
_RATIOS = {
    "sem_ratio": _share(*similarity._SEMANTIC), "div_ratio": _share("div"), "span_ratio": _share("span"), "svg_ratio": _share("svg"), "path_ratio": _share("path"), "img_ratio": _share("img"),
    "canvas_ratio": _share("canvas"), "heading_ratio": _share("h1", "h2", "h3", "h4", "h5", "h6"), "list_ratio": _share("ul", "ol", "li"), "max_depth": "max(depth) / 25", "mean_depth": "sum(depth) / count(*) / 15", "distinct_tags": "count(DISTINCT tag) / 40",
}
VIEW("semantic_ratios", f"""SELECT r.*, a.aria / elements AS aria_ratio, a.role / elements AS role_ratio, a.data_attr / elements AS data_ratio FROM
  (SELECT {KEYS}, count(*) AS elements, {', '.join(f'{e} AS {c}' for c, e in _RATIOS.items())} FROM {{nodes}} GROUP BY {KEYS}) r JOIN {{attribute_counts}} a ON r.slot = a.slot""")
VIEW("semantic_values", similarity.values("semantic_ratios", [(c, c) for c in [*_RATIOS, "aria_ratio", "role_ratio", "data_ratio"]]), " UNION ALL ".join(f"SELECT {KEYS}, '{c}' AS token, CAST({c} AS DOUBLE) AS value FROM {{semantic_ratios}} WHERE {c} <> 0" for c in [*_RATIOS, "aria_ratio", "role_ratio", "data_ratio"]))
channel("x_semantics_pairs", "semantic_values")

# c-ast-js by its token path: bigrams of the categories of script tokens
_SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script>"
_DUCK_TOKEN = JS_TOKEN.replace(r"[\s\S]", "(?s:.)")
_WORDS = ", ".join(f"'{w}'" for w in JS_WORDS)
FRAME("script_bigrams", lambda s, d, cards: _bigrams(cards), f"""SELECT {KEYS}, token, CAST(count(*) AS DOUBLE) AS value FROM (SELECT {KEYS}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS token FROM
  (SELECT {KEYS}, list_transform(list_filter(regexp_extract_all(js, {duck(_DUCK_TOKEN)}), lambda x: NOT starts_with(x, '//') AND NOT starts_with(x, '/*')), lambda x: CASE WHEN regexp_matches(x, '^["'']') THEN 'STR' WHEN starts_with(x, '`') THEN 'TMPL'
    WHEN regexp_matches(x, '^\\.?[0-9]') THEN 'NUM' WHEN x IN ({_WORDS}) THEN 'kw:' || x WHEN regexp_matches(x, '^[A-Za-z_$\\x{{80}}-\\x{{ffff}}]') THEN 'NAME' ELSE 'op:' || x END) AS t FROM
    (SELECT {KEYS}, array_to_string(regexp_extract_all(html, {duck(_SCRIPT)}, 1), chr(10)) AS js FROM cards))) GROUP BY ALL""".replace("{{", "{").replace("}}", "}"), "cards")


def _bigrams(cards: DataFrame) -> DataFrame:
    js = F.array_join(_all("html", _SCRIPT, 1), "\n")
    real = F.filter(_all(js, JS_TOKEN), lambda x: ~x.startswith("//") & ~x.startswith("/*"))
    kind = lambda x: F.when(x.rlike("^[\"']"), "STR").when(x.startswith("`"), "TMPL").when(x.rlike(r"^\.?[0-9]"), "NUM").when(x.isin(JS_WORDS), F.concat(F.lit("kw:"), x)).when(x.rlike(r"^[A-Za-z_$\x{80}-\x{ffff}]"), "NAME").otherwise(F.concat(F.lit("op:"), x))
    t = cards.select(*features.KEY, F.transform(real, kind).alias("t")).filter(F.size("t") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.concat(F.get("t", i), F.lit(" "), F.get("t", i + 1)))
    return t.select(*features.KEY, F.explode(pairs).alias("token")).groupBy(*features.KEY, "token").agg(F.count(F.lit(1)).cast("double").alias("value"))


channel("c_script_tokens_pairs", "script_bigrams")

QUERIES = "x_layout_pairs x_css_values_pairs c_css_prop_pairs x_color_pairs x_naming_pairs x_semantics_pairs c_script_tokens_pairs".split()
