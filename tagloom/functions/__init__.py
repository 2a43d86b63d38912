"""SQL expressions: bytes, image segments, tag directories, values, names.

The functions compose SQL text, which goes into ``F.expr`` or ``selectExpr``. A
layout of this depth takes thousands of Column objects, and seconds to build
them; as text, Spark parses it in one go. Every argument is itself SQL text.
"""
