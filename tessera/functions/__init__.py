"""Column functions: each takes and returns Columns, and runs in the JVM unless it says otherwise."""
