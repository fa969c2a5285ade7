"""What a fit leaves in the driver's process does not travel with the functions of the tasks."""

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from dealgrid.llm import language_id, text


def test_tables_of_the_hashes_stay_at_home():
    field = language_id.WordField(["a", "b"])
    texts = [b"eins zwei drei vier " * 30_000, b"one two three four " * 30_000]
    field.fit(texts, [0, 1], epochs=1)
    list(text.word_hashes(pa.array(["some words"]), "terms"))
    assert len(cloudpickle.dumps(lambda column: language_id.WordField.predict(field, column))) < field.weights.nbytes + 200_000
    assert len(cloudpickle.dumps(text.word_hashes)) < 100_000


def test_hashes_do_not_depend_on_the_length_of_the_buffer():
    words = "alpha beta gamma"
    long = words + " " * text.CHUNK + "delta"
    short, far = ([(hashes.tolist(), list(counts)) for _, _, hashes, counts in text.word_hashes(pa.array([t]), "terms")][0] for t in (words, long))
    assert far[0][:3] == short[0] and np.sum(far[1]) == 4
