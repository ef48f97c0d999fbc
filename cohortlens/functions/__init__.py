"""Column expressions: text in, text or arrays out, without Python workers unless said."""
