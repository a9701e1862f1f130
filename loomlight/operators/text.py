"""Tokens, weights, similarity and MinHash over documents, benchmark and embeddings."""

from __future__ import annotations

from .logs import query, staged

# Technical tokens and the MinHash family.
TECHNICAL = (
    r"(?i)^(get|post|put|delete|patch|head|options|connect|trace)$",
    r"^\d{3}$",
    r"(?i)^(error|exception|failed|failure|timeout|abort|cancel|reject)$",
    r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",
    r"(?i)\.(js|ts|jsx|tsx|py|java|c|cpp|h|php|rb|go|rs|html|css|json|xml|yaml|yml|md|txt|log)$",
    r"(?i)^[a-zA-Z_][a-zA-Z0-9_]*\([^)]*\)$",
    r"^/[a-zA-Z0-9/_-]*$",
    r"(?i)^(select|insert|update|delete|create|drop|alter|table|index|where|join|from|into)$",
)
#: Words that carry no meaning for similarity.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should may might must can shall "
    "this that these those i you he she it we they me him her us them my your his its our their what which who when where why how all any both each few more "
    "most other some such no nor not only own same so than too very just also then now here there up down left right back front side top bottom inside outside "
    "before after above below between among through across into onto from until while during since because although unless even though whether either neither else instead "
    "rather still yet again further moreover therefore however otherwise besides anyway meanwhile accordingly consequently finally furthermore hence likewise next nonetheless similarly "
    "subsequently thus according along amid amidst amongst around as aside astride away barring behind beneath beside beyond circa concerning considering despite due "
    "except excluding failing following forth given gone including like minus near nearby notwithstanding off opposite out over owing past pending per plus pro qua regarding "
    "respecting round save saving short subsequent thanks thence throughout thru till toward towards under underneath unlike unto upon versus via vice vis within without "
    "worth yes ok okay true false null undefined"
).split()
HASHES, BANDS, PER_BAND, PRIME = 100, 20, 5, 4294967291


def technical(d, e):
    return "(" + " or ".join(d.match(e, p) for p in TECHNICAL) + ")"


def basic(d, e):
    return d.filter(d.split(f"lower({e})", "[^a-z0-9]+"), "x <> ''")


def enhanced(d, src, key, text):
    """Step lists (key, kind, token) in order: technical twice, regular, 2-grams, 3-grams."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tech = d.map(d.filter(d.split(text, r"[^a-zA-Z0-9._/()-]+"), f"x <> '' and {technical(d, 'x')}"), "lower(x)")
    plain = d.filter(d.split(f"lower({text})", "[^a-z0-9._/-]+"), f"length(x) > 1 and x not in ({stop})")
    contains = "array_contains(tech, x)" if d.name == "spark" else "list_contains(tech, x)"
    n = d.size("reg")
    gram = lambda k: d.map(d.range("1", f"{n} - {k - 2}"), d.join(d.slice("reg", "x", str(k)), "' '"))
    return (
        ("a0", f"select {key}, {tech} as tech, {plain} as plain from {src}"),
        ("a1", f"select {key}, tech, {d.let('tech', 'tech', d.filter('plain', f'not {contains}'))} as reg from a0"),
        ("a2", f"select {key}, {d.size('tech')} as n_technical, {d.size('reg')} as n_regular, {d.let('reg', 'reg', d.concat_lists('tech', 'tech', 'reg', gram(2), gram(3)))} as tokens from a1"),
    )


def weights(d, key):
    w = f"(case when {technical(d, 'token')} then 3.0 else 1.0 end) * (case when {d.match('token', r'^\d{3}$')} then 2.0 else 1.0 end) * (case when token like '% %' then 1.5 else 1.0 end) * greatest(0.5, 1.0 - (cast(i as double) / n) * 0.5)"
    return (
        ("g0", d.explode("a2", key, "tokens", "i", "token")),
        ("g1", f"select {key}, count(*) as n from g0 group by {key}"),
        ("g2", f"select g0.{key}, token, cast({w} as double) as w from g0 join g1 on g0.{key} = g1.{key}"),
        ("g", f"select {key}, token, sum(w) as w from g2 group by {key}, token"),
    )


BENCH = ("b", "select item_id, lower(text) as text from benchmark where text is not null and item_id is not null")
#: The stated query set: items whose id is divisible by 50, against all others.
ASKED = "x.item_id % 50 = 0 and x.item_id <> y.item_id"
PAIRS = ("p", f"select x.item_id as a, y.item_id as b, x.text as ta, y.text as tb from b x join b y on {ASKED}")
DOCS = ("b", "select doc_id, coalesce(text, '') as text from documents")


def ascii_only(d):
    return d.sub("lower(text)", "[^a-z ]", "")


def signature(d):
    """(doc_id, sig) by the family (a x + b) mod p over 31-bit polynomial token hashes."""
    h = d.fold(d.map(d.chars("token"), d.code("x")), "cast(0 as bigint)", "(acc * 31 + x) % 2147483648")
    return (
        ("t0", d.explode("documents", "doc_id", basic(d, "coalesce(text, '')"), "i", "token")),
        ("t1", "select distinct doc_id, token from t0"),
        ("t2", f"select token, {h} as h from (select distinct token from t1) u"),
        ("t3", "select doc_id, h from t1 join t2 on t1.token = t2.token"),
        ("s", "select doc_id, " + ", ".join(f"min((h * {2 * i + 1} + {2 * i + 2}) % {PRIME}) as m{i}" for i in range(HASHES)) + " from t3 group by doc_id"),
    )


SAME = " and ".join(f"s.m{i} = e.m{i}" for i in range(HASHES))


def classes(d):
    """Documents of equal signature: smallest id, and whether an id divisible by 50 is among them."""
    every = ", ".join(f"m{i}" for i in range(HASHES))
    return (("e", f"select min(doc_id) as class, max(case when doc_id % 50 = 0 then 1 else 0 end) as asked, {every} from s group by {every}"),)


def banded(d, src="s", key="doc_id"):
    band = lambda k: f"concat('{k}'" + "".join(f", '-', cast(m{k * PER_BAND + j} as string)" for j in range(PER_BAND)) + ")"
    return (("z", d.explode(src, key, d.list(*(band(k) for k in range(BANDS))), "band", "bucket")),)


class signed(staged):
    """Signatures and their classes are written once."""

    CUTS = ("s", "e")


def candidates(d):
    """The asked classes, which hold a doc_id divisible by 50: any member of a bucket meets any other that differs."""
    return (
        ("l", "select distinct x.class as a, y.class as b from z x join z y on x.bucket = y.bucket join e on e.class = x.class and e.asked = 1 where x.class <> y.class"),
        ("k", "select a, b, cast(" + " + ".join(f"case when x.m{i} = y.m{i} then 1 else 0 end" for i in range(HASHES)) + f" as double) / {HASHES} as similarity from l join e x on x.class = a join e y on y.class = b"),
    )


def cosine(d, a, b):
    zipped = f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (acc, x) -> acc + x)" if d.name == "spark" else f"list_sum(list_transform(list_zip({a}, {b}), lambda x: cast(x[1] as double) * cast(x[2] as double)))"
    return zipped


# Limits of what is taken in.
MOST_MB, MOST_TOKENS, MOST_EVENTS, MOST_LINE, MOST_LINES = 100, 1000, 50_000, 2_000_000, 500_000
SIZE = "length(text) * 2.0 / 1048576"


def validated(d):
    return f"case when text is null then 'Input must be a string' when text = '' then 'Input cannot be empty' when {SIZE} > {MOST_MB} then concat('Log size exceeds maximum (', '{MOST_MB}', 'MB)') else '' end"


QUERIES = {
    "validate_input": lambda d: query(("v", f"select doc_id, text, {validated(d)} as error from documents"), ("", f"select doc_id, error = '' as is_valid, error, cast(round({SIZE}, 2) as double) as size_mb from v")),
    "validate_tokens": lambda d: query(("v", "select doc_id, text, cast(ceil(length(text) / 4.0) as bigint) as n_tokens from documents"), ("", f"select doc_id, n_tokens, coalesce(text <> '' and n_tokens <= {MOST_TOKENS}, false) as is_valid from v")),
    "sanitize_lines": lambda d: query(("k", d.explode("documents", "doc_id", d.split("coalesce(text, '')", r"\n"), "line_no", "line")), ("n", f"select *, cast(row_number() over (partition by doc_id order by line_no) as bigint) as nth from k where length(line) <= {MOST_LINE}"), ("", f"select doc_id, nth, line from n where nth <= {MOST_LINES}")),
    "empty_input": lambda d: query(("", f"select doc_id, case when text is null or not {d.match('text', r'\S')} then 'No log provided.' end as answer from documents")),
    "lines_split": lambda d: query(("", d.explode("documents", "doc_id", d.split("coalesce(text, '')", r"\r?\n"), "line_no", "line"))),
    "tokens_basic": lambda d: query(("", f"select doc_id, {d.size(basic(d, 'coalesce(text, ' + chr(39) * 2 + ')'))} as n_tokens, {d.size(d.distinct_sorted(basic(d, 'coalesce(text, ' + chr(39) * 2 + ')')))} as n_distinct from documents")),
    "tokens_enhanced": lambda d: query(DOCS, *enhanced(d, "b", "doc_id", "text"), ("", f"select doc_id, n_technical, n_regular, {d.size('tokens')} as n_tokens, {d.join('tokens', chr(39) + '|' + chr(39))} as tokens from a2")),
    "token_weights": lambda d: query(DOCS, *enhanced(d, "b", "doc_id", "text"), *weights(d, "doc_id"), ("", "select doc_id, token, round(w, 6) as weight from g")),
    "token_stats": lambda d: query(DOCS, *enhanced(d, "b", "doc_id", "text"), *weights(d, "doc_id"), ("", "select g.doc_id, cast(count(*) as bigint) as n_unique, cast(sum(case when token like '% %' then 1 else 0 end) as bigint) as n_grams, round(sum(w), 5) as total_weight, max(n_technical) as n_technical from g join a2 on g.doc_id = a2.doc_id group by g.doc_id")),
    "token_estimate": lambda d: query(("", "select doc_id, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) as n_tokens from documents")),
    "sim_levenshtein_pairs": lambda d: query(("b", f"select item_id, {ascii_only(d)} as text from benchmark where text is not null"), PAIRS, ("", "select a, b, cast(levenshtein(ta, tb) as bigint) as distance, round(cast(levenshtein(ta, tb) as double) / greatest(length(ta), length(tb)), 6) as ratio from p where length(ta) + length(tb) > 0")),
    "sim_jaccard_pairs": lambda d: query(
        BENCH,
        ("k", d.explode("b", "item_id", basic(d, "text"), "i", "t")),
        ("u", "select distinct item_id, t from k"),
        ("n", "select item_id, count(*) as n from u group by item_id"),
        ("c", f"select x.item_id as a, y.item_id as b, count(*) as n_both from u x join u y on x.t = y.t and {ASKED} group by 1, 2"),
        ("", "select a, b, round(cast(n_both as double) / (na.n + nb.n - n_both), 6) as jaccard from c join n na on na.item_id = a join n nb on nb.item_id = b"),
    ),
    "sim_weighted_jaccard": lambda d: query(
        BENCH,
        *enhanced(d, "b", "item_id", "text"),
        *weights(d, "item_id"),
        ("n", "select item_id, sum(w) as total from g group by item_id"),
        ("c", f"select x.item_id as a, y.item_id as b, sum(least(x.w, y.w)) as low from g x join g y on x.token = y.token and {ASKED} group by 1, 2"),
        ("", "select a, b, round(low / (na.total + nb.total - low), 5) as similarity from c join n na on na.item_id = a join n nb on nb.item_id = b"),
    ),
    "sim_semantic_pairs": lambda d: query(
        BENCH,
        ("k", d.explode("b", "item_id", d.filter(d.split("text", "[^a-z0-9_]+"), "length(x) > 2"), "i", "t")),
        ("u", "select distinct item_id, t from k"),
        ("n", "select item_id, count(*) as n from u group by item_id"),
        ("c", f"select x.item_id as a, y.item_id as b, count(*) as n_both from u x join u y on x.t = y.t and {ASKED} group by 1, 2"),
        ("", "select a, b, round(cast(n_both as double) / (na.n + nb.n - n_both), 6) as similarity from c join n na on na.item_id = a join n nb on nb.item_id = b"),
    ),
    "sim_cosine_topk": lambda d: query(
        ("v", f"select vec_id, label, embedding, sqrt({cosine(d, 'embedding', 'embedding')}) as norm from embeddings"),
        ("p", f"select q.vec_id as query_id, v.vec_id as vec_id, round({cosine(d, 'q.embedding', 'v.embedding')} / (q.norm * v.norm), 6) as similarity from (select * from v where vec_id % 50 = 0) q join v on q.vec_id <> v.vec_id where q.norm > 0 and v.norm > 0"),
        ("", "select query_id, vec_id, similarity, rank from (select *, cast(row_number() over (partition by query_id order by similarity desc, vec_id) as bigint) as rank from p) t where rank <= 5"),
    ),
    "minhash_signature": lambda d: query(*signature(d), ("", "select * from s")),
    "lsh_classes": signed(signature, classes, select="select doc_id, class from s join e on " + SAME),
    "lsh_candidates": signed(signature, classes, lambda d: banded(d, "e", "class"), candidates, select="select a, b, similarity from k where similarity >= 0.5"),
    "lsh_bucket_stats": lambda d: query(*signature(d), *banded(d), ("k", "select band, bucket, count(*) as n from z group by band, bucket"), ("", "select cast(band as bigint) as band, cast(min(n) as bigint) as smallest, cast(max(n) as bigint) as largest, round(avg(cast(n as double)), 6) as mean, cast(count(*) as bigint) as buckets from k group by band")),
    "sample_last_n": lambda d: query(("", "select user_id, event_id, nth from (select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as bigint) as nth from events) t where nth <= 5")),
    "sample_strided": lambda d: query(("", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as nth from events) t where (nth - 1) % 2 = 0")),
}
