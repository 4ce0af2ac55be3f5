"""Column builders: text, answers, score vectors and token arrays."""
