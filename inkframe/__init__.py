"""inkframe: glyph data, text layout and corpus work as PySpark DataFrame operators."""
