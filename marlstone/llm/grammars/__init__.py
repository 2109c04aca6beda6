"""Parsing-expression grammars of the known languages, and the packrat machine that runs them."""
