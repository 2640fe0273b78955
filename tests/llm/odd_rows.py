"""Texts of the odd rows: nulls, empty and very long texts, copies, repeated rows and ids."""

LONG = " ".join(f"word{i} runs" for i in range(9000)) + " " + "x" * 30000
TEXTS = [(1, "The quick brown fox jumps over the lazy dog, again and again and again."),
         (2, "The quick brown fox jumps over the lazy dog, again and again and again."),
         (2, "The quick brown fox jumps over the lazy dog, again and again and again."),
         (3, None), (4, ""), (5, "   \n\t "), (None, "a row without an id has a text too"), (None, None),
         (6, "naïve café Σίσυφος ΑΣ 日本語 <|endoftext|> end"), (7, "one"), (8, LONG), (9, LONG + " tail"),
         (7, "the same id with another text")]
