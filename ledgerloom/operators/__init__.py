"""DataFrame operators: matching, checking, patching, glossary and quality."""
