"""Quotation linking: which message a quoted passage comes from, and conversations in reply order.

A line's quote level is the number of ``>`` before its text; blanks may stand between them. Neighbouring
lines of one level, up to a line without text, are a passage. Passages are normalised (lower case, one
space for any white space) and hashed. A message can be quoted by any of its own lines, by any of its
paragraphs, and as a whole, so all of these are hashed too and joined to the quoted hashes. A passage
that none of these of its own conversation equals is looked for inside messages, as a row of words
without regard to lines and punctuation: messages with its rarest run of ``RUN`` words are candidates,
and a shorter passage is a run itself, whose first holders are grouped minima too.

The original of a passage is the first message of the same conversation that holds it before the
quoting one, else the first message of another conversation that holds it. First holders are grouped
minima, so a passage that everybody holds is one row before it is joined, and no pair of equal passages
ever arises. A message replies to the original of its least deeply, then first quoted linked passage in
its own conversation. Roots and depths come from doubling the reply pointers.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.batches import name_column, written

BLANKS = " \t\r\n\f"
PREFIX = r"^[ \t]*(?:>[ \t]?)*"
KEY = ["conv_id", "turn", "tag"]
RUN = 4


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "), F.lit(BLANKS)))


def messages_of(conversations: DataFrame) -> DataFrame:
    """The distinct messages, each with a tag that tells messages of one turn apart."""
    return (conversations.select(
        name_column("conv_id").cast("long").alias("conv_id"),
        name_column("turn").cast("long").alias("turn"),
        name_column("role").cast("string").alias("role"),
        F.coalesce(name_column("text").cast("string"), F.lit("")).alias("text")).distinct()
        .withColumn("tag", F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), "text"))))


def lines_of(messages: DataFrame) -> DataFrame:
    """One row per line: its place, quote level, and the text behind the quote signs."""
    prefix = F.regexp_extract("line", PREFIX, 0)
    return (messages.select(*KEY, F.posexplode(F.split("text", "\n")).alias("place", "line"))
            .select(*KEY, "place", F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"),
                    F.substr("line", F.length(prefix) + 1).alias("content")))


def passages_of(lines: DataFrame) -> DataFrame:
    """Runs of lines of one level without an empty line between them: level, first place, hash.

    A run lies inside one message, so a window holds no more than the lines of one row.
    """
    order = Window.partitionBy(*KEY).orderBy("place")
    empty = F.col("norm") == ""
    starts = (F.lag("level").over(order).isNull() | (F.lag("level").over(order) != F.col("level"))
              | F.lag(empty).over(order))
    runs = (lines.withColumn("norm", normalised(F.col("content")))
            .withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(order))
            .filter(~empty))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "norm"))),
                                      lambda x: x["norm"]), " ")
    return (runs.groupBy(*KEY, "run", "level").agg(F.min("place").alias("place"),
                                                   joined.alias("said"))
            .withColumn("hash", F.md5("said")).drop("run"))


def holdings(lines: DataFrame, passages: DataFrame, bodies: DataFrame) -> DataFrame:
    """``conv_id, turn, hash`` of everything that a message says itself and may be quoted by."""
    single = (lines.filter("level = 0").select("conv_id", "turn", normalised(F.col("content")).alias("n"))
              .filter("n <> ''").select("conv_id", "turn", F.md5("n").alias("hash")))
    paragraphs = passages.filter("level = 0").select("conv_id", "turn", "hash")
    whole = (bodies.select("conv_id", "turn", normalised(F.col("body")).alias("n"))
             .filter("n <> ''").select("conv_id", "turn", F.md5("n").alias("hash")))
    return single.union(paragraphs).union(whole).filter("conv_id is not null and turn is not null")


def linked_quotes(quotes: DataFrame, held: DataFrame) -> DataFrame:
    """``quotes`` plus from_conv and from_turn of each passage's original, null if it has none."""
    wanted = quotes.select("hash").distinct()
    some = held.join(wanted, "hash", "left_semi")
    inside = some.groupBy("hash", "conv_id").agg(F.min("turn").alias("first_turn"))
    # The two conversations that hold a passage first: one of them is not the quoting one.
    first = inside.groupBy("hash").agg(F.min(F.struct("conv_id", "first_turn")).alias("one"))
    second = (inside.join(first, "hash").filter(F.col("conv_id") != F.col("one.conv_id"))
              .groupBy("hash").agg(F.min(F.struct("conv_id", "first_turn")).alias("two")))
    found = (quotes.join(inside, ["hash", "conv_id"], "left").join(first, "hash", "left")
             .join(second, "hash", "left"))
    same = F.col("first_turn") < F.col("turn")
    other = (F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one"))
             .when(F.col("one.conv_id") == F.col("conv_id"), F.col("two")))
    return found.select(
        *quotes.columns,
        F.when(same, F.col("conv_id")).otherwise(other["conv_id"]).alias("from_conv"),
        F.when(same, F.col("first_turn")).otherwise(other["first_turn"]).alias("from_turn"))


def spoken(text: Column) -> Column:
    """The words of a text, one blank before and behind each."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def runs_of(words: Column, sizes: list[Column]) -> Column:
    """All runs of so many words, hashed. The lambda's variable holds the words, split once."""
    def of(w: Column, size: Column) -> Column:
        return F.when(F.size(w) >= size, F.transform(
            F.sequence(F.lit(1), F.size(w) - size + 1),
            lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))).otherwise(
            F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.flatten(F.transform(
        F.array(words), lambda w: F.array(*[of(w, k) for k in sizes])))))


def holdings_inside(passages: DataFrame, bodies: DataFrame) -> DataFrame:
    """``conv_id, turn, hash`` of the messages whose words have those of a passage (hash, words) in a row.

    Every passage meets the messages that hold its rarest run only.
    """
    words = F.split(F.btrim("words"), " ")
    wanted = written(passages.select("hash", F.explode(runs_of(words, [F.least(F.lit(RUN), F.size(words))]))
                                     .alias("run")), "wanted_runs")
    said = (bodies.filter("conv_id is not null and turn is not null")
            .select("conv_id", "turn", spoken(F.col("body")).alias("own")).distinct())
    said = written(said.withColumn("id", F.md5("own")), "spoken")
    own = F.split(F.btrim("own"), " ")
    texts = said.select("id", "own").distinct()
    runs = texts.select("id", F.explode(runs_of(own, [F.lit(RUN)])).alias("run"))
    runs = written(runs.distinct().join(wanted.select("run").distinct(), "run", "left_semi"), "held_runs")
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = (wanted.join(counts, "run", "left").groupBy("hash")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("least"))
              .select("hash", F.col("least.run").alias("run")))
    met = (rarest.join(runs, "run").join(passages, "hash").join(texts, "id")
           .filter(F.contains("own", "words")).select("hash", "id"))
    return said.join(met, "id").select("conv_id", "turn", "hash")


def holdings_of_short(passages: DataFrame, bodies: DataFrame) -> DataFrame:
    """The same for passages of fewer than RUN words: these are runs themselves, and their texts the key.

    A word that everybody says is a row for each message that says it, never a pair of messages;
    ``linked_quotes`` takes the first of each conversation before anything is shuffled.
    """
    wanted = passages.select("hash", F.btrim("words").alias("run"))
    own = F.split(F.btrim(spoken(F.col("body"))), " ")

    def of(w: Column, size: int) -> Column:
        return F.when(F.size(w) >= size, F.transform(
            F.sequence(F.lit(1), F.size(w) - size + 1),
            lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))

    def runs(w: Column) -> Column:
        return F.array_distinct(F.flatten(F.array(*[of(w, size) for size in range(1, RUN)])))

    said = (bodies.filter("conv_id is not null and turn is not null")
            .select("conv_id", "turn", F.explode(F.flatten(F.transform(F.array(own), runs))).alias("run")))
    return said.join(wanted, "run").select("conv_id", "turn", "hash")


def linked_inside(links: DataFrame, bodies: DataFrame) -> DataFrame:
    """``links`` with the originals that hold a passage as a part, where no own message equals it.

    The own conversation comes first, then messages elsewhere that equal it, then those that hold it.
    """
    words = spoken(F.col("said"))
    own = F.col("from_conv").eqNullSafe(F.col("conv_id")) & F.col("from_turn").isNotNull()
    rest = (links.filter(~own)
            .withColumnsRenamed({"from_conv": "whole_conv", "from_turn": "whole_turn"}))
    passages = written(rest.select("hash", words.alias("words")).filter("btrim(words) <> ''").distinct(),
                       "inner_passages")
    short = F.size(F.split(F.btrim("words"), " ")) < RUN
    held = holdings_inside(passages.filter(~short), bodies).union(
        holdings_of_short(passages.filter(short), bodies))
    found = linked_quotes(rest, held)
    inside = F.col("from_conv") == F.col("conv_id")
    taken = F.when(inside, F.struct("from_conv", "from_turn")).when(
        F.col("whole_turn").isNotNull(), F.struct(F.col("whole_conv").alias("from_conv"),
                                                  F.col("whole_turn").alias("from_turn"))).otherwise(
        F.struct("from_conv", "from_turn"))
    return links.filter(own).unionByName(found.withColumn("taken", taken).select(
        *[c for c in links.columns if not c.startswith("from_")], "taken.from_conv", "taken.from_turn"))


def reply_roots(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, root_turn, depth`` for every turn that replies, by doubling its pointer.

    A reply goes to an earlier turn, so there are no circles; the number of rounds is the logarithm of
    the deepest thread. Each round is written to the shared folder.
    """
    state = written(replies.select("conv_id", "turn", F.col("to_turn").alias("root_turn"),
                                   F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")),
                    "replies")
    while not state.filter("moved").isEmpty():
        up = state.select("conv_id", F.col("turn").alias("root_turn"),
                          F.col("root_turn").alias("up_turn"), F.col("depth").alias("up_depth"))
        state = written(state.join(up, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", F.coalesce("up_turn", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"),
            F.col("up_turn").isNotNull().alias("moved")), "replies")
    return state.drop("moved")


def reply_order(conversations: DataFrame) -> DataFrame:
    """One row per distinct message without its quotes, in reply order.

    Columns: conv_id, turn, role, body (own lines, trimmed), n_quotes and n_linked (passages),
    reply_to_turn, quoted_conv and quoted_turn (the original of the first linked passage, which may lie
    in another conversation), root_turn and depth of its thread. Threads follow each other by the turn
    of their root, replies by depth, then turn.

    Repeated rows are one message; several messages of one turn share its place in the thread, and the
    turn's reply is that of the message with the earliest original. Null texts are empty. Messages
    without conv_id or turn keep their body and quotes, but are no originals and reply to nothing; those
    without conv_id link to nothing either. Their root is their own turn. An empty table gives no rows.
    """
    messages = messages_of(conversations)
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    lines = lines_of(messages.filter(quoting))
    parsed = written(passages_of(lines), "passages")
    quotes = written(parsed.filter("level > 0"), "quotes")
    own = (lines.filter("level = 0").groupBy(*[F.col(k).alias(f"o_{k}") for k in KEY])
           .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))),
                                         lambda x: x["content"]), "\n").alias("body")))
    bodies = (messages.filter(~quoting).select(*KEY, "role", F.col("text").alias("body"))
              .unionByName(messages.filter(quoting).select(*KEY, "role")
                           .join(own, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in KEY], "left")
                           .select(*KEY, "role", "body"))
              .withColumn("body", F.btrim(F.coalesce("body", F.lit("")), F.lit(BLANKS))))
    bodies = written(bodies, "bodies")
    if quotes.isEmpty():
        plain = bodies.select(
            "conv_id", "turn", "role", "body", F.lit(0).cast("long").alias("n_quotes"),
            F.lit(0).cast("long").alias("n_linked"),
            *[F.lit(None).cast("long").alias(c) for c in ("reply_to_turn", "quoted_conv", "quoted_turn")],
            F.col("turn").alias("root_turn"), F.lit(0).cast("long").alias("depth"))
        return _ordered(plain)
    own_lines = lines_of(bodies.select(*KEY, F.col("body").alias("text")))
    held = holdings(own_lines, passages_of(own_lines), bodies)
    links = written(linked_quotes(quotes, held), "links")
    links = written(linked_inside(links, bodies), "links")
    linked = F.col("from_turn").isNotNull()
    same = linked & (F.col("from_conv") == F.col("conv_id"))
    rank = F.struct("level", "place", "from_conv", "from_turn")
    by_message = links.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count(F.when(linked, 1)).alias("n_linked"),
        F.min(F.when(linked, rank)).alias("q"), F.min(F.when(same, rank)).alias("r"))
    replies = (by_message.filter("r is not null and conv_id is not null and turn is not null")
               .groupBy("conv_id", "turn").agg(F.min("r.from_turn").alias("to_turn")))
    replies = written(replies, "reply_to")
    roots = reply_roots(replies)
    facts = by_message.select(*[F.col(k).alias(f"m_{k}") for k in KEY], "n_quotes", "n_linked",
                              F.col("q.from_conv").alias("quoted_conv"),
                              F.col("q.from_turn").alias("quoted_turn"))
    places = (replies.join(roots, ["conv_id", "turn"])
              .select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"),
                      F.col("to_turn").alias("reply_to_turn"), "root_turn", "depth"))
    out = (bodies.join(facts, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in KEY], "left")
           .join(places, (F.col("conv_id") == F.col("p_conv")) & (F.col("turn") == F.col("p_turn")),
                 "left"))
    return _ordered(out.select(
        "conv_id", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to_turn", "quoted_conv", "quoted_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth")))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("conv_id", "root_turn", "depth", "turn", "role", F.md5("body"))


# The same in DuckDB, straight from the definitions.
ORACLE = r"""
WITH RECURSIVE messages AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
tagged AS (SELECT *, md5(coalesce(role, '') || chr(10) || text) AS tag FROM messages),
split AS (
  SELECT conv_id, turn, tag, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place FROM tagged),
lines AS (
  SELECT conv_id, turn, tag, place,
         length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)*'), '[^>]', '', 'g')) AS level,
         substr(line, length(regexp_extract(line, '^[ \t]*(?:>[ \t]?)*')) + 1) AS content FROM split),
bodies AS (
  SELECT t.conv_id, t.turn, t.role, t.tag, trim(coalesce(b.body, ''), E' \t\r\n\f') AS body
  FROM tagged t LEFT JOIN (
    SELECT conv_id, turn, tag, string_agg(content, chr(10) ORDER BY place) AS body
    FROM lines WHERE level = 0 GROUP BY ALL) b
  ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.turn IS NOT DISTINCT FROM b.turn AND t.tag = b.tag),
own_split AS (
  SELECT conv_id, turn, tag, unnest(string_split(body, chr(10))) AS content,
         generate_subscripts(string_split(body, chr(10)), 1) AS place FROM bodies),
all_lines AS (
  SELECT true AS quoted, conv_id, turn, tag, place, level, content FROM lines
  UNION ALL SELECT false, conv_id, turn, tag, place, 0, content FROM own_split),
clean AS (
  SELECT *, lower(trim(regexp_replace(content, '[ \t\r\n\f]+', ' ', 'g'), E' \t\r\n\f')) AS norm
  FROM all_lines),
marked AS (
  SELECT *, CASE WHEN lag(level) OVER w IS NULL OR lag(level) OVER w <> level OR lag(norm) OVER w = ''
                 THEN 1 ELSE 0 END AS opens
  FROM clean WINDOW w AS (PARTITION BY quoted, conv_id, turn, tag ORDER BY place)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY quoted, conv_id, turn, tag ORDER BY place) AS run FROM marked),
passages AS (
  SELECT quoted, conv_id, turn, tag, level, min(place) AS place,
         md5(string_agg(norm, ' ' ORDER BY place)) AS hash
  FROM numbered WHERE norm <> '' GROUP BY quoted, conv_id, turn, tag, level, run),
quotes AS (SELECT conv_id, turn, tag, level, place, hash FROM passages WHERE quoted AND level > 0),
held AS (
  SELECT conv_id, turn, hash FROM passages WHERE NOT quoted
  UNION SELECT conv_id, turn, md5(norm) FROM clean WHERE NOT quoted AND norm <> ''
  UNION SELECT conv_id, turn, md5(lower(trim(regexp_replace(body, '[ \t\r\n\f]+', ' ', 'g'))))
  FROM bodies WHERE body <> ''),
firsts AS (
  SELECT hash, conv_id, min(turn) AS first_turn FROM held
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
links AS (
  SELECT q.*, CASE WHEN f.first_turn < q.turn THEN q.conv_id ELSE o.o.c END AS from_conv,
         CASE WHEN f.first_turn < q.turn THEN f.first_turn ELSE o.o.t END AS from_turn
  FROM quotes q
  LEFT JOIN firsts f ON f.hash = q.hash AND f.conv_id = q.conv_id
  LEFT JOIN (
    SELECT q.hash, q.conv_id, min({'c': f.conv_id, 't': f.first_turn}) AS o
    FROM (SELECT DISTINCT hash, conv_id FROM quotes WHERE conv_id IS NOT NULL) q
    JOIN firsts f ON f.hash = q.hash AND f.conv_id <> q.conv_id
    GROUP BY ALL) o ON o.hash = q.hash AND o.conv_id = q.conv_id),
facts AS (
  SELECT conv_id, turn, tag, count(*) AS n_quotes, count(from_turn) AS n_linked,
         min({'l': level, 'p': place, 'c': from_conv, 't': from_turn})
           FILTER (WHERE from_turn IS NOT NULL) AS q,
         min({'l': level, 'p': place, 'c': from_conv, 't': from_turn})
           FILTER (WHERE from_turn IS NOT NULL AND from_conv = conv_id) AS r
  FROM links GROUP BY conv_id, turn, tag),
replies AS (
  SELECT conv_id, turn, min(r.t) AS to_turn FROM facts
  WHERE r IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
chain AS (
  SELECT conv_id, turn, to_turn AS root_turn, 1 AS depth FROM replies
  UNION ALL
  SELECT c.conv_id, c.turn, r.to_turn, c.depth + 1
  FROM chain c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.root_turn),
roots AS (
  SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM chain GROUP BY ALL)
SELECT b.conv_id, b.turn, b.role, b.body, coalesce(f.n_quotes, 0) AS n_quotes,
       coalesce(f.n_linked, 0) AS n_linked, p.to_turn AS reply_to_turn,
       f.q.c AS quoted_conv, f.q.t AS quoted_turn,
       coalesce(r.root_turn, b.turn) AS root_turn, CAST(coalesce(r.depth, 0) AS BIGINT) AS depth
FROM bodies b
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.turn IS NOT DISTINCT FROM b.turn
  AND f.tag = b.tag
LEFT JOIN replies p ON p.conv_id = b.conv_id AND p.turn = b.turn
LEFT JOIN roots r ON r.conv_id = b.conv_id AND r.turn = b.turn
"""
