"""Licences of several blocks inside longer texts."""

from polyview.llm import licenses


def test_texts_of_several_blocks_are_found_inside_others(spark):
    full = {name: texts[-1] for name, texts in licenses.KNOWN.items() if "\n\n" in texts[-1]}
    mit = full["MIT"]
    wrapped = "\n".join("# " + " ".join(mit.split()[k : k + 9]) for k in range(0, len(mit.split()), 9))
    texts = {
        1: ("MIT", f"MIT License\n\nCopyright (c) 2020 Someone\n\n{mit}"),
        2: ("MIT", f"The MIT License (MIT)\nCopyright (c) 2020 Someone\n{mit}\n"),
        3: ("MIT", f"Some words.\n\n{mit}\n\nMore words."),
        4: ("MIT", f"intro\n{wrapped}\nend"),
        5: ("ISC,MIT", f"{mit}\n\n{full['ISC']}\n\n{mit}"),
        6: ("", f"Title\n\n{mit.replace('free of charge', 'for a charge')}"),
        7: ("", f"Title\n\n{mit.rsplit(' ', 1)[0]}"),
        8: ("", "permission is hereby granted, free of charge"),
        9: ("", f"Title\n\nx{mit}"),
        **{20 + k: (name, f"Title of {name}\n\n{t}\n\nEnd") for k, (name, t) in enumerate(full.items())},
    }
    docs = spark.createDataFrame([(k, t) for k, (_, t) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {k: r["license_ids"] for k, r in got.items()} == {k: name for k, (name, _) in texts.items()}
    assert not any(r["whole"] for r in got.values())
    assert got[5]["n_units"] == 2 and got[3]["n_units"] == 1
    assert licenses.scan(spark.createDataFrame([(1, mit)], "doc_id long, text string")).first()["n_units"] == 1
