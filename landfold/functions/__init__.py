"""Column functions: geometry, codecs, text, geodesy. Everything stays JVM-side."""
