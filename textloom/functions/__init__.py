"""Column expressions: analysis, wiki text, snippets."""
