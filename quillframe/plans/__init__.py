"""From SQL text to DataFrames: lexer, parser, compiler, session."""
