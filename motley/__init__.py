"""motley: aggregate answers over tables that were never normalised to one another.

Every operator is a DataFrame plan.  Sub-packages:

* ``sources``   - declarative source specs, readers and writers
* ``functions`` - Column expressions (cleaning, n-grams, similarities, vectors)
* ``operators`` - joins, dictionaries, aggregates, encoders on DataFrames
* ``plans``     - estimators, evaluation and gap estimates built from operators
* ``streaming`` - incremental forms on Structured Streaming
"""
