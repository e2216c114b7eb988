"""Scalar functions as column expressions: strings, JSON, time, and arithmetic of media facts. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- strings ----


def human_bytes(n: Column) -> Column:
    """1536 -> '1.5 KB': below 1024 whole bytes, then two decimals without trailing zeros; the last unit is TB; null stays null.

    Decimals are rounded exactly, halves to the even digit, as printf does: in whole numbers, as format_string() rounds halves up.
    """
    v = n.cast("long")

    def text(power: int) -> Column:
        unit = 1 << 10 * power
        share = (v % unit) * 100  # in hundredths of a unit, times the unit
        part, rest = F.shiftright(share, 10 * power), share % unit
        cents = part + F.when((rest > unit // 2) | ((rest == unit // 2) & (part % 2 == 1)), 1).otherwise(0)
        whole = F.shiftright(v, 10 * power) + F.when(cents == 100, 1).otherwise(0)
        digits = F.regexp_replace(F.lpad((cents % 100).cast("string"), 2, "0"), "0+$", "")
        return F.concat(whole.cast("string"), F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits)))

    out = F.when(v < 1024, F.concat(v.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(v < 1 << 10 * (power + 1), F.concat(text(power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(text(4), F.lit(" TB")))


def parse_size(text: Column) -> Column:
    """'1.5 GB' -> bytes by binary units; what doesn't read as a size is 0."""
    t = F.upper(F.trim(text))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*[KMGT]?B?$", 1)
    unit = F.regexp_extract(t, r"^\d+(?:\.\d+)?\s*([KMGT]?)B?$", 1)
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit(0)).otherwise(F.floor(number.try_cast("double") * F.pow(F.lit(1024.0), power))).cast("long")


def version_parts(text: Column) -> Column:
    """'v2.10.3-rc1' -> [2, 10, 3]; missing or unreadable parts are 0, a prerelease mark is ignored."""
    core = F.split(F.regexp_replace(F.split(F.coalesce(text, F.lit("")), "[-+]", 2)[0], "^v", ""), r"\.")
    return F.array(*[F.coalesce(F.get(core, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3)])


def version_newer(a: Column, b: Column) -> Column:
    return version_parts(a) > version_parts(b)


def path_safe(name: Column) -> Column:
    """A name as a folder: control characters and < > : \" / \\ | ? * give _, and no name is 'unknown'."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', "_"))


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


_FOLDERS = {"images": "photo", "stickers": "photo", "videos": "video", "gifs": "video", "audio": "audio", "documents": "document", "others": "document"}
#: The extension lists in which a file's extension is looked for as a substring.
_EXTENSIONS = ((".jpg.jpeg.png.webp.heic.heif.gif", "photo"), (".mp4.mov.avi.mkv.webm", "video"), (".mp3.ogg.wav.m4a.opus.flac", "audio"))


def file_type(path: Column) -> Column:
    """By the parent folder, else by the extension as a substring of a list: so a file without one is a photo."""
    parts = F.split(slashed(path), "/")
    parent = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    out = reduce(lambda w, kv: w.when(parent == kv[0], kv[1]), list(_FOLDERS.items())[1:], F.when(parent == "images", "photo"))
    for names, kind in _EXTENSIONS:
        out = out.when(F.contains(F.lit(names), extension(path)), kind)
    return out.otherwise("document")


def synthetic_id(path: Column) -> Column:
    """A negative id from a path: minus the first 32 bits of its SHA-256 (0 counts as 1)."""
    n = F.conv(F.substring(F.sha2(path, 256), 1, 8), 16, 10).cast("long")
    return -F.when(n == 0, F.lit(1)).otherwise(n)


def contains_folded(column: Column, text: str) -> Column:
    """A substring test without regard to ASCII case; % _ and \\ stand for themselves."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def tokens(*columns: Column) -> Column:
    """The words of columns: runs of letters and digits, lowered."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def prefix_terms(search: str) -> list[str]:
    """Terms of a search text: quotes go, the rest splits at white space, and again at what separates tokens."""
    import re

    return [t for word in search.replace("'", "").replace('"', "").lower().split() for t in re.split(r"[\W_]+", word) if t]


def matches_prefixes(terms: list[str], *columns: Column) -> Column:
    """Whether each term begins a word of the columns."""
    held = tokens(*columns)
    return reduce(lambda a, b: a & b, [F.exists(held, _begins(term)) for term in terms], F.lit(True))


def _begins(term: str):
    return lambda t: F.startswith(t, F.lit(term))


def term_score(terms: list[str], *columns: Column) -> Column:
    """How many words the terms begin: the rank of search results (ties by id)."""
    held = tokens(*columns)
    return reduce(lambda a, b: a + b, [F.size(F.filter(held, _begins(term))) for term in terms], F.lit(0))


# ---- links ----


def message_link(link: Column) -> Column:
    """struct(chat, message, topic) of a message link (web or app form), or null for what is none.

    A private channel's number c stands for the chat -100...c; repeated or contradictory parameters make no link.
    """
    t = F.trim(link)
    t = F.when(t.rlike(r"^(t\.me|telegram\.me|telegram\.dog)/"), F.concat(F.lit("https://"), t)).otherwise(t)
    web = r"(?i)^https?://(?:t\.me|telegram\.me|telegram\.dog)/+(?-i)(?:s/)?"
    query = F.regexp_extract(t, r"\?([^#]*)", 1)
    part = lambda name: F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    has = lambda name: query.rlike(rf"(?:^|&){name}(=|&|$)")
    twice = reduce(lambda a, b: a | b, [query.rlike(rf"(?:^|&){n}=?.*&{n}(=|&|$)") for n in ("domain", "channel", "post", "thread")])
    path = F.split(F.regexp_replace(F.regexp_replace(F.regexp_extract(t, web + r"([^?#]*)", 1), "/+$", ""), "^/+", ""), "/")
    private = F.get(path, F.lit(0)) == "c"
    rest = F.when(private, F.slice(path, 3, F.greatest(F.size(path) - 2, F.lit(0)))).otherwise(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))))
    is_web, resolve, post = t.rlike(web), t.rlike(r"^tg:(//)?resolve\?"), t.rlike(r"^tg:(//)?privatepost\?")
    channel = F.when(is_web & private, F.get(path, F.lit(1))).when(post, part("channel"))
    user = F.when(is_web & ~private, F.get(path, F.lit(0))).when(resolve, part("domain"))
    message = F.when(is_web & (F.size(rest) >= 1) & (F.size(rest) <= 2), F.element_at(rest, -1)).when(resolve | post, part("post"))
    of_path = F.when(is_web & (F.size(rest) == 2), rest[0])
    topic = F.when(has("thread"), part("thread")).otherwise(of_path)
    number = lambda x, most: F.when(x.rlike(r"^[0-9]+$"), x.try_cast("long")).cast("long")
    chat = F.when(channel.rlike(r"^[0-9]{1,12}$") & (channel.try_cast("long") > 0), (F.lit(-1_000_000_000_000) - channel.try_cast("long")).cast("string")).when(channel.isNull() & user.rlike(r"^[A-Za-z][A-Za-z0-9_]{3,31}$"), F.concat(F.lit("@"), user))
    m, k = number(message, 2_147_483_647), number(topic, 2_147_483_647)
    fine = chat.isNotNull() & m.between(1, 2_147_483_647) & (topic.isNull() | k.between(1, 2_147_483_647)) & ~has("comment") & ~twice & ~(is_web & has("thread") & of_path.isNotNull() & (of_path != part("thread")))
    return F.when(fine, F.struct(chat.alias("chat"), m.alias("message"), F.when(topic.isNotNull(), k).alias("topic")))


def chat_query_kind(text: Column) -> Column:
    """What a chat search text names: username, id, name, invite, message or unsupported."""
    q = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(q, r"^https?://", ""), r"^www\.", "")
    parts = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^t\.me/", ""), "/+$", ""), "^/+", ""), "/")
    head, n = parts[0], F.size(parts)
    number = lambda x: x.rlike(r"^-?[0-9]+$")
    last = F.element_at(parts, -1)
    return (
        F.when(q.startswith("@"), "username")
        .when(number(q) & q.startswith("-100"), "id")
        .when(~bare.startswith("t.me/"), "name")
        .when(head == "", "unsupported")
        .when((head == "joinchat") | (head.startswith("+") & ~number(F.substring(head, 2, 1000))), "invite")
        .when(head.startswith("+"), "unsupported")
        .when(head == "c", F.when((n >= 3) & number(F.get(parts, F.lit(1))) & number(last), "message").otherwise("unsupported"))
        .when(head.isin("addstickers", "proxy"), "unsupported")
        .when(n == 1, "username")
        .when((n == 2) & number(F.get(parts, F.lit(1))), "message")
        .otherwise("unsupported")
    )


# ---- JSON ----


def json_object(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def json_set(text: Column, key: str, value: Column) -> Column:
    """A flat JSON object of strings with one key set."""
    held = F.from_json(text, "map<string,string>")
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string"))))


# ---- time ----


def millis(text: Column) -> Column:
    """Epoch milliseconds of a mixed timestamp: whole milliseconds, RFC 3339 or 'YYYY-MM-DD hh:mm:ss'; else 0."""
    t = F.trim(text.cast("string"))
    whole = F.when(t.rlike(r"^-?\d+$"), t.try_cast("long"))
    return F.coalesce(whole, F.unix_millis(F.try_to_timestamp(t)), F.lit(0))


def retention_deadline(seen_millis: Column, hours: Column) -> Column:
    """When a message's grace ends: hours are held between 1 and 720, and 48 where there are none."""
    return seen_millis + F.greatest(F.lit(1), F.least(F.lit(720), F.coalesce(hours, F.lit(48)))).cast("long") * 3_600_000


def history_bound(text: Column) -> Column:
    """Unix seconds of a date bound: seconds, milliseconds (over 1e11), YYYY-MM-DD or RFC 3339; empty is 0, else null."""
    t = F.trim(text)
    n = t.try_cast("double")
    seconds = F.when(n > 1e11, n / 1000).when(n.isNotNull(), n).otherwise(F.unix_seconds(F.try_to_timestamp(t)).cast("double"))
    return F.when((t == "") | t.isNull(), F.lit(0)).when((seconds >= 0) & (seconds <= 2_147_483_647) & ~F.isnan(seconds), F.floor(seconds)).cast("long")


def _cron_field(raw: str, value: Column, lo: int, hi: int) -> Column:
    found = F.lit(False)
    for part in raw.split(","):
        where, *steps = part.split("/")
        if len(steps) > 1 or (steps and not 1 <= int(steps[0]) <= hi - lo + 1):
            raise ValueError(f"step of {raw!r}")
        ends = [lo, hi] if where == "*" else [int(x) for x in where.split("-")]
        if len(ends) > 2 or not lo <= ends[0] <= ends[-1] <= hi:
            raise ValueError(f"range of {raw!r}")
        found = found | (value.between(ends[0], ends[-1]) & ((value - ends[0]) % (int(steps[0]) if steps else 1) == 0))
    return found


def cron_matches(expression: str, at: Column) -> Column:
    """Whether a time meets a five-field schedule; with both day fields given, either will do. ValueError if it is none."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    values = (F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1)
    minute, hour, day, month, week = (_cron_field(f, v, lo, hi) for f, v, (lo, hi) in zip(fields, values, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6)), strict=True))
    return minute & hour & month & ((day | week) if fields[2] != "*" and fields[4] != "*" else (day & week))


# ---- arithmetic ----


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of the same even length; -1 if they aren't that."""
    fine = a.rlike("^([0-9A-Fa-f]{2})+$") & (F.length(a) == F.length(b)) & b.rlike("^[0-9A-Fa-f]+$")
    word = lambda x, i: F.conv(F.substring(x, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    bits = F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(a) - 1) / 8).cast("int"))), F.lit(0), lambda s, i: s + F.bit_count(word(a, i).bitwiseXOR(word(b, i))).cast("int"))
    return F.when(fine, bits).otherwise(F.lit(-1))


def duration_bucket(seconds: Column, width: int = 120) -> Column:
    return F.floor(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) / width).cast("long")


def durations_within(a: Column, b: Column, tolerance: float) -> Column:
    most = F.greatest(a, b)
    return F.when(most <= 0, F.lit(True)).otherwise(F.abs(a - b) / most <= tolerance)


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes; 0 if they don't meet."""
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = aw * ah + bw * bh - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def l2_normalised(v: Column) -> Column:
    """A unit vector; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def face_quality(det: Column, size: Column, sharpness: Column, regularity: Column, pose: Column) -> Column:
    """Weighted by 0.30, 0.20, 0.20, 0.15, 0.15; each part held to 0..1 (0.5 for unknown landmarks or pose); four places."""
    held = lambda x, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(d))))
    total = 0.30 * held(det, 0.0) + 0.20 * held(size, 0.0) + 0.20 * held(sharpness, 0.0) + 0.15 * held(regularity, 0.5) + 0.15 * held(pose, 0.5)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def nsfw_label(score: Column) -> Column:
    return F.when(score >= 0.5, "nsfw").otherwise("sfw")


#: Longest duration of a tier, seconds between its frames, its most frames.
SPRITE_TIERS = ((15, 0.5, 30), (60, 1.0, 60), (300, 3.0, 100), (900, 5.0, 180), (1800, 7.0, 300), (3600, 9.0, 450), (7200, 12.0, 600), (float("inf"), 18.0, 720))


def sprite_plan(duration: Column, interval: float = 0.0, most_tiles: int = 0, columns: int = 10) -> Column:
    """struct(frames, interval, cols, row_count) of a preview sheet for so many seconds of video; 0 columns means 10."""
    frames = None
    for longest, density, most in SPRITE_TIERS:
        density = max(0.5, interval) if interval > 0 else density
        n = F.least(F.greatest(F.ceil(duration / density), F.lit(8)), F.lit(most))
        frames = F.when(duration <= longest, n) if frames is None else frames.when(duration <= longest, n)
    frames = F.least(frames, F.lit(most_tiles)) if most_tiles else frames
    frames, cols = frames.cast("long"), max(2, min(20, columns or 10))
    return F.struct(frames.alias("frames"), (duration / frames).alias("interval"), F.lit(cols).alias("cols"), F.greatest(F.lit(1), F.ceil(frames / cols)).cast("long").alias("row_count"))


def evenly_spaced(frames: Column, n: int) -> Column:
    """n indexes k * frames / n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * frames / n).cast("long"))


def top_mean(scores: Column, k: int = 3) -> Column:
    """The mean of the k greatest."""
    best = F.slice(F.sort_array(scores, asc=False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x, lambda s: F.when(F.size(best) > 0, s / F.size(best)))
