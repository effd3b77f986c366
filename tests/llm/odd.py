"""A table of odd documents, for the edge cases of every operator."""

LONG = " ".join(f"w{k % 977} thing" for k in range(30_000))
TEXTS = [
    None, "", " ", "\n\n", "one", "the same text of a few words\nthe same text of a few words", "the same text of a few words\nthe same text of a few words",
    "mail bob.b@mail.example.com, a@b@c.d or x@y; 10.0.0.1 1.2.3.4.5.6.7.8 300.1.1.1 card 4111 1111 1111 1111 call +1 (212) 555-0100. see https://example.org/a?b=1.",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" DE89370400440532013000 at 12 Elm Tree Street +123 ++1 2 3 4 5 6 7 8 4539578763621486',
    "Ünïcödé ﬁ ſ İstanbul ΑΣ é  nbsp em 𝔘 12½ ²³ <|endoftext|>x <|startoftext|> it's WE'LL 'S\u0085next \x1c\x00 ‍ 中文字符 ½",
    "x" * 5000, LONG, "a  b   c ", " lead and trail ", "tab\tsep\x0bvt\x0cff\rcr", "▁piece▁ ▁", "you id.iot and m-o-r-o-n , i d i o t",
]
ROWS = [(k, t, "en", "s", len(t or ""), 7, 90 - k) for k, t in enumerate(TEXTS)] + [(3, "again three", None, None, None, 8, None), (None, "no id here at all", "en", "s", 3, 9, 5)]


def odd(spark):
    """With an extra column, a null id and a repeated id."""
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint, sequence_id int, row_key bigint")


def none(spark):
    return odd(spark).where("false")
