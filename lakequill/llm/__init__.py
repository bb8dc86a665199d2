"""Operations of a training-data pipeline. Nothing outside this subpackage imports it but the guard in __spark_entry__.py."""
