"""Functions paired with their documentation (problem 3).

Source is lexed by one regular expression into tokens, which become rows. A running sum of
opening and closing brackets gives the depth of each token; a line break at depth 0 begins a
logical line. Logical lines are islands of tokens, aggregated without another shuffle, and
windows over them attach what follows a signature (docstring or comments) and the comments before
it. Where the text of a function is wanted, islands of lines deeper than its definition delimit
it. Rows of one source share its key; a repository that holds a third of all rows is spread by
file and chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

#: One token: string, comment, line break with the next indent, bracket, or other text with brackets closed in it.
LEX = (
    r'(\"\"\"(?s:.*?)(?<!\\)\"\"\"|' r"'''(?s:.*?)(?<!\\)'''"
    r'|\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"?|' r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
    r"|#[^\n]*+|\r?\n[ \t\f]*+|[(\[{]|[)\]}]|(?:[^\r\n\"'#()\[\]{}]++|\([^()\[\]{}\"'#\r\n]*+\)|\r)++)"
)

#: Documentation that says nothing, in lower case, letters and digits only.
NOTHING = (
    "todo tbd na none null pass fixme xxx docstring doc docs documentation description nodescription nodocumentation nodocstring placeholder "
    "summary summaryline desc emptydocstring missingdocstring missing undocumented tobedone tobewritten tobedocumented tobedefined wip stub "
    "notimplemented notdocumented notdocumentedyet undocumentedfunction function method class adddocstring addadocstring adddescription writeme "
    "documentme describeme fillme fillmein explain lorem loremipsum foo bar test temp"
).split()

#: Reminders to write documentation, and heads and lines of sections without content.
REMINDER = (
    r"(?is)^\W*(?:(?:todo|fixme|xxx|tbd|hack|note|nb)\b\W*(?:\(\w*\)\W*)?)*(?:please\s+|we\s+(?:should|must|need\s+to)\s+|need(?:s|ed)?\s+(?:to\s+)?|should\s+|must\s+|will\s+|to\s+)*(?:be\s+)?"
    r"(?:(?:write|add|fill|put|insert|complete|finish|supply|provide|document|describe|explain|improve|update|extend)(?:ed|d|ten)?\b[^.\n]{0,40}?\b(?:docs?|docstrings?|documentation|description|comments?|this|me|it|here|later|function|method|in)\b[^.\n]{0,40}"
    r"|(?:docs?|docstrings?|documentation|description|comments?)\b\W*(?:is\s+|are\s+)?(?:missing|needed|required|pending|later|goes\s+here|here|to\s+(?:do|come|follow)|todo|tbd|coming\s+soon)\b[^.\n]{0,40}"
    r"|(?:your|the|some|insert|no|missing|empty)\s+(?:docs?|docstring|documentation|description|comments?|summary)\b(?:\s+(?:here|goes\s+here|yet|available|provided|given))?"
    r"|(?:document|describe|explain)(?:\s+(?:me|this|it))?)\W*$"
)
SECTION = (
    r"(?im)^\s*(?:args?|arguments?|param(?:eter)?s?|other parameters|returns?|return value|yields?|raises?|throws|exceptions?|examples?|notes?|attributes|keyword args|see also|usage|warnings?|todo)\s*:?\s*$"
    r"|^\s*[-=~*#_]{2,}\s*$|^\s*[:@](?:param|type|return|returns|rtype|raises?|throws|arg|yields?)\b[^:\n]*:?\s*$|^\s*\*{0,2}\w+\s*(?:\([\w\[\], .]*\))?\s*:\s*(?:\w+\s*)?$|^\s*(?:none|todo|tbd|\.\.\.)\s*$"
)
#: A comment line that is code taken out of use.
DEAD_CODE = (
    r"^#\s*(?:[\w.\[\]\"', ]+\s*(?:[-+*/%|&^]|//|\*\*|<<|>>)?=(?!=)\s*\S.*|[\w.]+\(.*\)\s*;?|(?:return|yield|raise|import|from|del|assert|print|global|nonlocal)\b.*[(=.\[].*|(?:return|yield|break|continue|pass)(?:\s+[\w.]+)?"
    r"|(?:if|elif|while|for|with|try|else|except|def|class)\b.*:\s*|@[\w.]+.*|[-=#*~_]+|!.*|\s*(?:noqa|type:|pylint|pragma|fmt:|mypy|nosec|region|endregion).*)$"
)

KEY = ["seq", "chunk_idx"]


def tokens(chunks: DataFrame) -> DataFrame:
    """``(seq, chunk_idx, type, pos, tok)``: the tokens of every function and class chunk."""
    code = F.regexp_replace("code", r"\r\n?", "\n")
    return (
        chunks.where(F.col("type").isin("function", "class") & F.col("code").isNotNull() & F.col("seq").isNotNull())
        .select(*KEY, "type", F.posexplode(F.regexp_extract_all(code, F.lit(LEX), F.lit(1))).alias("pos", "tok"))
    )


def lines(chunks: DataFrame, text: bool = False) -> DataFrame:
    """Logical lines: key, ``line``, ``indent``, ``kind``, ``name`` of a definition, ``said`` by a comment or string.

    ``kind``: def, class, at (a decorator), com, str, blank or code; ``tail`` is the string that
    follows the colon of a definition on its own line. ``text``: with the whole text of the line.
    """
    at = W.partitionBy(*KEY).orderBy("pos")
    first = F.substring("tok", 1, 1)
    t = tokens(chunks.dropDuplicates(KEY))
    t = t.withColumn("step", F.when(first.isin("(", "[", "{") & (F.length("tok") == 1), 1).when(first.isin(")", "]", "}"), -1).otherwise(0))
    t = t.withColumn("depth", F.sum("step").over(at)).withColumn("before", F.lag("tok").over(at))
    starts = (F.col("pos") == 0) | ((first == "\n") & (F.col("depth") <= 0) & ~F.coalesce(F.col("before").endswith("\\"), F.lit(False)))
    t = t.withColumn("line", F.sum(starts.cast("int")).over(at))
    word = F.when((first != "\n"), F.struct("pos", "tok"))
    string = first.isin('"', "'")
    comment = first == "#"
    ordered = t.groupBy(*KEY, "line").agg(
        F.first("type").alias("type"),
        F.min(F.struct("pos", "tok")).getField("tok").alias("opening"),
        F.min(word).getField("tok").alias("lead"),
        F.min(F.when(string, F.struct("pos", "tok"))).getField("tok").alias("string"),
        F.min(F.when(comment, F.struct("pos", "tok"))).getField("tok").alias("comment"),
        F.max(F.when((first != "\n") & ~comment & ~((F.trim("tok") == "") | (F.trim("tok") == ";")), F.struct("pos", "tok", "before"))).alias("last"),
        F.sum((~string & (first != "\n") & ~comment & ~F.trim("tok").isin("", "r", "R", "u", "U", ";")).cast("int")).alias("others"),
        *([F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "").alias("text")] if text else []),
    )
    lead = F.ltrim("lead")
    kind = (
        F.when(F.col("lead").isNull() | (F.trim("lead") == "") & (F.col("others") == 0) & F.col("string").isNull() & F.col("comment").isNull(), "blank")
        .when(F.substring(lead, 1, 1) == "#", "com")
        .when((F.col("others") == 0) & F.col("string").isNotNull(), "str")
        .when(lead.rlike(r"^(?:async\s+)?def\b"), "def")
        .when(lead.rlike(r"^class\b"), "class")
        .when(lead.startswith("@"), "at")
        .otherwise("code")
    )
    indent = F.when(F.substring("opening", 1, 1) == "\n", F.length(F.regexp_replace(F.regexp_replace("opening", r"^\n", ""), "\t", "        "))).otherwise(0)
    return ordered.select(
        *KEY, "type", "line", indent.alias("indent"), kind.alias("kind"),
        F.when(kind == "def", F.regexp_extract(lead, r"^(?:async\s+)?def\s+([^\s(\[:]+)", 1)).alias("name"),
        F.when(kind == "com", F.col("comment")).when(kind == "str", F.col("string")).alias("said"),
        F.when((kind == "def") & F.substring(F.col("last.tok"), 1, 1).isin('"', "'") & F.col("last.before").rlike(r":\s*[rRuU]?$"), F.col("last.tok")).alias("tail"),
        *(["text"] if text else []),
    )


def unquoted(string):
    """The content of a string token."""
    return F.regexp_replace(F.regexp_replace(string, r"\A(?:\"\"\"|'''|\"|')", ""), r"(?:\"\"\"|'''|\"|')\z", "")


def says_something(doc, name):
    """``_says`` of each row's documentation and name, which are made once however often it looks at them."""
    return F.exists(F.array(F.struct(doc.alias("doc"), name.alias("name"))), lambda x: _says(x["doc"], x["name"]))


def _says(doc, name):
    """Is ``doc`` documentation: more than blanks, punctuation, a placeholder, a reminder, an empty skeleton or the name?"""
    bare = F.lower(F.regexp_replace(doc, r"(?U)[^\p{L}\p{N}]+", ""))
    unmarked = F.regexp_replace(doc, r"(?i)\A\W*(?:(?:todo|fixme|xxx|hack|nb|note|tbd)\b[\s:!.,-]*)+", "")
    bare_unmarked = F.lower(F.regexp_replace(unmarked, r"(?U)[^\p{L}\p{N}]+", ""))
    plain_name = F.lower(F.regexp_replace(name, r"(?U)[^\p{L}\p{N}]+", ""))
    skeleton = F.regexp_replace(F.regexp_replace(doc, SECTION, ""), r"(?U)[^\p{L}\p{N}]+", "")
    return (
        doc.isNotNull()
        & (bare_unmarked != "")
        & ~bare.isin(*NOTHING) & ~bare_unmarked.isin(*NOTHING)
        & (bare_unmarked != plain_name) & (bare != plain_name)
        & ~F.regexp_replace(bare_unmarked, r"^(?:the|this|a)|(?:function|method)$", "").eqNullSafe(plain_name)
        & ~doc.rlike(REMINDER)
        & (skeleton != "")
    )


def definitions(found: DataFrame) -> DataFrame:
    """Definitions among logical lines with their documentation: key, ``line``, ``indent``, ``name``, ``doc``, null if they have none."""
    at = W.partitionBy(*KEY).orderBy("line")
    rows = found
    comment = F.col("kind") == "com"
    dead = F.col("said").rlike(DEAD_CODE)
    rows = rows.withColumn("comment", comment & ~dead)
    # islands of comment lines, of decorators and of what they stand before
    rows = rows.withColumn("fresh", F.coalesce(F.lag(F.col("comment")).over(at) != F.col("comment"), F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("fresh").over(at))
    of_island = W.partitionBy(*KEY, "island")
    rows = rows.withColumn(
        "whole", F.when(F.col("comment"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.regexp_replace("said", r"^#+:?\s*", "").alias("s"))).over(of_island)), lambda x: x["s"]), "\n"))
    ).withColumn("depth", F.when(F.col("comment"), F.col("indent")))
    # a comment reaches a definition over decorators
    base = rows.withColumn("carry", F.when(F.col("kind") != "at", F.struct("comment", "whole", F.col("indent").alias("at"))))
    base = base.withColumn("above", F.last("carry", ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, -1)))
    base = base.withColumn("next", F.lead(F.struct("kind", "said", "comment", "whole", "indent")).over(at))
    back = W.partitionBy(*KEY).orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1)
    base = base.withColumn("after", F.last(F.when(~F.col("kind").isin("com", "blank"), F.struct("line", "kind", "said", "indent")), ignorenulls=True).over(back))
    body = F.min(F.when(F.col("kind").isin("def", "at", "str", "code", "com", "class") & (F.col("line") > 1), F.struct("line", "indent"))).over(W.partitionBy(*KEY))
    base = base.withColumn("body", body.getField("indent"))
    is_doc = (F.col("after.kind") == "str") & (F.col("after.indent") > F.col("indent"))
    below = F.when(F.col("next.comment") & (F.col("next.indent") > F.col("indent")), F.col("next.whole"))
    above = F.when((F.col("type") == "class") & (F.col("line") > 1) & (F.col("indent") == F.col("body")) & F.col("above.comment") & (F.col("above.at") == F.col("indent")), F.col("above.whole"))
    doc = F.when(F.col("tail").isNotNull(), unquoted(F.col("tail"))).when(is_doc, unquoted(F.col("after.said"))).otherwise(F.coalesce(above, below))
    # where either is empty of meaning the other still documents
    doc = F.when(F.col("tail").isNull() & ~is_doc & above.isNotNull() & ~says_something(above, F.col("name")), below).otherwise(doc)
    return base.where("kind = 'def' and name <> ''").select(*KEY, "type", "line", "indent", "name", doc.alias("doc"))


def documented(chunks: DataFrame) -> DataFrame:
    """``(seq, func_name)`` of every function or method with documentation of its own, distinct.

    ``chunks``: seq, chunk_idx, type, code (docstring and name where code is missing). Chunks
    delivered twice count once; null or empty code, and rows without a key, give nothing, unless
    a function chunk without code has a docstring; other columns are not read.
    """
    found = definitions(lines(chunks))
    rows = found.where(says_something(F.col("doc"), F.col("name"))).select("seq", F.col("name").alias("func_name"))
    bare = chunks.where("type = 'function' and code is null and name is not null and seq is not null")
    bare = bare.where(says_something(F.col("docstring"), F.col("name"))).select("seq", F.col("name").alias("func_name"))
    return rows.unionByName(bare).distinct()


def pairs(chunks: DataFrame) -> DataFrame:
    """``(seq, func_name, code, doc)``: every documented function with its text.

    The text of a function ends before the next line that is no deeper than its definition:
    for each depth at which a chunk has definitions, a running count of such lines numbers the
    islands. A function that stands in several chunks (its own and its class) comes once, with the
    longest documentation. Order of rows is undefined.
    """
    from ..session import stage

    found = stage(lines(chunks, text=True), "lines")
    docs = definitions(found).where(says_something(F.col("doc"), F.col("name")))
    levels = docs.select(*KEY, F.col("indent").alias("level")).distinct()
    rows = found.join(levels, KEY)
    at = W.partitionBy(*KEY, "level").orderBy("line")
    closes = (F.col("indent") <= F.col("level")) & ~F.col("kind").isin("blank", "com")
    rows = rows.withColumn("island", F.sum(closes.cast("int")).over(at))
    real = F.when(~F.col("kind").isin("blank", "com"), F.col("line"))
    rows = rows.withColumn("last", F.max(real).over(W.partitionBy(*KEY, "level", "island"))).where(F.col("line") <= F.col("last"))
    parts = rows.groupBy(*KEY, "level", "island").agg(
        F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias("code")
    )
    out = docs.join(parts, [*KEY, "line"]).where("indent = level")
    best = F.max(F.struct(F.length("doc"), F.length("code"), "doc", F.regexp_replace("code", r"\A\n[ \t]*", "").alias("code"))).alias("b")
    return out.groupBy("seq", F.col("name").alias("func_name")).agg(best).select("seq", "func_name", F.col("b.code").alias("code"), strip(F.col("b.doc")).alias("doc"))


#: One token of a language with braces: comment, literal, brace or semicolon, directive, or the text between; together they are the whole source.
BRACES = (
    r"(//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|\"(?:[^\"\\\n]|\\[\s\S])*+\"?|'(?:[^'\\\n]|\\[\s\S])*+'?|`(?:[^`\\]|\\[\s\S])*+`?|[{};]"
    r"|(?:\A|\n)[ \t]*+#[^\n]*+|(?:[^\"'`{};/\n]|/(?![/*])|\n(?![ \t]*#))++)"
)
#: Suffixes of files that ``brace_pairs`` reads.
BRACED = (".js", ".jsx", ".mjs", ".ts", ".tsx", ".java", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".go", ".rs", ".kt", ".swift", ".scala", ".php")
#: Words before a bracket that begin a statement, not a function.
NO_NAME = "if for while switch catch return else do with synchronized using lock foreach when match sizeof typeof new throw await function fn func"
#: The head of a function: a name, its parameters, and what may stand between them and the brace; or a name that an arrow function gets.
HEAD = r"(?s)([A-Za-z_$~][\w$]*)\s*(?:<[^<>(){}]*>\s*)?\([^{}]*\)\s*(?::\s*[\w\s<>\[\].|,&?*]+|->\s*[\w\s<>\[\].&':,*]+|throws\s+[\w\s,.]+|const|override|noexcept|final|\[[^\]]*\]|[\w.*\[\]]+|\(\s*[\w\s,.*\[\]]*\))?\s*\z"
ARROW = r"(?s)([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^{}]*\)|[A-Za-z_$][\w$]*)\s*(?::\s*[\w<>\[\].| ]+)?=>\s*\z"


def brace_pairs(chunks: DataFrame) -> DataFrame:
    """``(seq, func_name, code, doc)``: documented functions of files in languages with braces, ``BRACED``.

    Tokens become rows; the running sum of braces gives their depth. Tokens up to a brace or
    semicolon are one island, its last comments on lines of their own are the documentation, its
    text between these and an opening brace is a head. The closing brace of a body is the one after as many
    openings at that depth. Lexical: a brace in a regular expression, or a type in braces among
    the parameters, hides that function. Chunks delivered twice count once; null and empty
    contents and files of other suffixes give nothing.
    """
    from ..session import stage

    suffix = F.regexp_extract("path", r"(\.[^./\\]+)$", 1)
    held = chunks.where(F.col("type").eqNullSafe("file") & F.col("content").isNotNull() & F.col("seq").isNotNull() & suffix.isin(*BRACED))
    held = stage(held.select(*KEY, F.regexp_replace("content", r"\r\n?", "\n").alias("content")).dropDuplicates(KEY), "braced")
    at = W.partitionBy(*KEY).orderBy("pos")
    t = held.select(*KEY, F.posexplode(F.regexp_extract_all("content", F.lit(BRACES), F.lit(1))).alias("pos", "tok"))
    mark = F.col("tok").isin("{", "}", ";")
    t = t.withColumn("begin", F.sum(F.length("tok")).over(at) - F.length("tok")).withColumn("depth", F.sum(F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)).over(at))
    t = t.withColumn("island", F.sum(mark.cast("int")).over(at) - mark.cast("int"))
    # openings at each depth are counted; the closing brace that comes back to the depth has the same count
    level = F.when(F.col("tok") == "{", F.col("depth") - 1).when(F.col("tok") == "}", F.col("depth"))
    braces = t.where(level.isNotNull()).withColumn("level", level)
    braces = braces.withColumn("nth", F.sum((F.col("tok") == "{").cast("int")).over(W.partitionBy(*KEY, "level").orderBy("pos")))
    closing = braces.where("tok = '}'").groupBy(*KEY, "level", "nth").agg((F.min("begin") + 1).alias("end"))
    opening = braces.where("tok = '{'").select(*KEY, "island", "level", "nth")
    # comments on lines of their own, and what stands after the last of them in an island
    before = F.coalesce(F.lag("tok").over(at), F.lit("\n"))
    comment = F.col("tok").startswith("//") | F.col("tok").startswith("/*")
    own = comment & (before.rlike(r"\n[ \t]*\z|\A[{};]\z|\A/[/*]") | (F.col("pos") == 0))
    aside = mark | comment | F.col("tok").rlike(r"\A\n?[ \t]*#")
    word = ~aside & F.col("tok").rlike(r"\S")
    of_island = W.partitionBy(*KEY, "island")
    rows = t.withColumn("own", own).withColumn("aside", aside).withColumn("last", F.max(F.when(own, F.col("pos"))).over(of_island))
    rows = rows.where("last is not null").withColumn("since", F.coalesce(F.max(F.when(word & (F.col("pos") < F.col("last")), F.col("pos"))).over(of_island), F.lit(-1)))
    said = rows.where("own and pos > since")
    said = said.groupBy(*KEY, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "\n").alias("said"))
    heads = rows.where("not aside and pos > last").groupBy(*KEY, "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "").alias("head"), F.min("begin").alias("begin")
    )
    heads = heads.withColumn("begin", F.col("begin") + F.length("head") - F.length(F.regexp_replace("head", r"\A\s+", "")))
    arrow = F.regexp_extract("head", ARROW, 1)
    name = F.when(arrow != "", arrow).otherwise(F.regexp_extract("head", HEAD, 1))
    found = said.join(heads, [*KEY, "island"]).join(opening, [*KEY, "island"]).withColumn("func_name", name).where((F.col("func_name") != "") & ~F.col("func_name").isin(*NO_NAME.split()))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("said", r"(?m)^\s*(?:/\*+!?|//+[/!]?)|\*+/\s*$", ""), r"(?m)^[ \t]*\*+ ?", ""), r"(?m)[ \t]+$", "")
    found = found.withColumn("doc", strip(plain)).where(says_something(F.col("doc"), F.col("func_name")))
    places = found.join(closing, [*KEY, "level", "nth"]).select(*KEY, "func_name", "doc", "begin", "end")
    code = F.substring(F.col("content"), (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    return places.join(held, KEY).select("seq", "func_name", code.alias("code"), "doc").distinct()
