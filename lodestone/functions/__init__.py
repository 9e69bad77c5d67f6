"""Column expressions: text, taxonomy ids, rule ladders, numbers and arrays. All run on the JVM unless a docstring says otherwise."""
