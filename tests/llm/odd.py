"""Texts at the edges."""


def odd_texts():
    """Nulls, empty texts, white space, very long texts, and repeated rows."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[i * i % 10] + str(i % 97) for i in range(30_000))
    return [None, "", "   ", "A.", "a b\tc", "a  b c", "x" * 5000, long, long, "123 456", None, "héllo wörld ▁ ok\n\nnew", "日本語 テキスト"]
