"""Column-expression builders.  Everything here returns a ``Column`` made of
built-in functions, so it compiles into whole-stage codegen."""
