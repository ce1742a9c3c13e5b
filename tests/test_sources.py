import datetime

import pytest

from ticketloom.sources.tickets import TICKET_SCHEMA, read_tickets, read_tickets_csv


def write(path, text, encoding="ISO-8859-1"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_by_heading(spark, tmp_path):
    p = write(tmp_path / "t.csv", "Resumen;Ticket ID;Otra;Notas;Causa Raiz;created_at\n"
                                  "Error CUPS;T1;x;nota;Batch;2024-01-02 03:04:05\nSin;T2;;;;bad\n")
    df = read_tickets_csv(spark, p)
    assert df.schema.names == TICKET_SCHEMA.names
    a, b = sorted(df.collect())
    assert (a.ticket_id, a.resumen, a.notas, a.causa_raiz, a.tipo_ticket) == ("T1", "Error CUPS", "nota", "Batch", None)
    assert a.created_at == datetime.datetime(2024, 1, 2, 3, 4, 5) and b.created_at is None and b.notas is None


def test_csv_files_that_differ_are_an_error(spark, tmp_path):
    write(tmp_path / "a.csv", "Ticket ID;Resumen\nT1;uno\n")
    write(tmp_path / "b.csv", "Resumen;Ticket ID\ndos;T2\n")
    with pytest.raises(Exception, match="CSV header"):
        read_tickets_csv(spark, str(tmp_path)).collect()


def test_two_spellings_and_missing_columns(spark, tmp_path):
    p = write(tmp_path / "t.json", '{"Ticket ID":"T1","Resumen":"r","Causa Ra\u00edz":null,"Causa Raiz":"x"}\n'
                                   '{"Ticket ID":"T2","Resumen":"s","Causa Ra\u00edz":"y","prioridad":"Alta"}\n', "utf-8")
    a, b = sorted(read_tickets(spark, p, "json").collect())
    assert (a.causa_raiz, b.causa_raiz, b.prioridad) == ("x", "y", "Alta")
    p = write(tmp_path / "v.json", '{"TICKET ID":"T1"," rEsumen ":null,"RESUMEN":"r","notas":"n"}\n{"x":1}\nno json\n', "utf-8")
    got = {(r.ticket_id, r.resumen, r.notas) for r in read_tickets(spark, p, "json").collect()}
    assert got == {("T1", "r", "n"), (None, None, None)}
    p = write(tmp_path / "u.csv", "A;Resumen\n1;2\n")
    with pytest.raises(ValueError, match="ticket_id"):
        read_tickets_csv(spark, p)
