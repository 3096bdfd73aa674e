"""Operations for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a DataFrame interface; ``queries`` registers one thin query per
operator and the DuckDB statements that check them.
"""
