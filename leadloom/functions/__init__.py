"""Column functions: Column in, Column out, all JVM-side unless a docstring says otherwise."""
