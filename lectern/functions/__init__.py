"""Scalar functions as Column expressions; all run inside the JVM unless their docstring says otherwise."""
