"""Fixed values of the ticket domain.

Every table here holds values that results depend on: word lists, phrase lists,
patterns, category texts.  Order matters wherever a first match or a tie is
decided by position.  Each operator takes its table as a parameter, so another
domain can pass its own.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Columns joined into the text of a ticket, in this order.
TEXT_COLUMNS = ("resumen", "notas", "tipo_ticket", "causa_raiz", "resolucion")

# Courtesy phrases removed one after another, as substrings.
COURTESY_PHRASES = (
    "buenos días", "cordial saludo", "gracias", "un saludo", "saludos",
    "muchas gracias", "quedo atento", "quedo atenta", "favor", "por favor",
    "adjunto", "envío", "enviado", "estimado", "estimada", "hola", "buen día",
)

# Fixed values: (synonym, canonical term), applied one after another.
SYNONYMS = (
    ("fallo", "error"), ("incidencia", "error"), ("problema", "error"),
    ("rechazo", "error"), ("cancelación", "baja"), ("anulación", "baja"),
    ("activación", "alta"), ("creación", "alta"), ("cambiar", "modificar"),
    ("actualizar", "modificar"), ("corregir", "modificar"),
)

# Stop words of the cluster keywords.
KEYWORD_STOPWORDS = (
    "de", "la", "el", "en", "y", "a", "es", "se", "no", "te", "lo", "le", "da",
    "su", "por", "con", "para", "como", "las", "del", "los", "un", "una", "al",
    "que", "fue", "son", "han", "muy", "más", "este", "esta", "ese", "esa",
    "tiene", "hacer", "todo", "año", "día", "mes", "vez", "caso", "forma", "parte",
)

# Further stop words of the analyzer.
ANALYZER_STOPWORDS = KEYWORD_STOPWORDS + (
    "pero", "sin", "sobre", "entre", "hasta", "donde", "cuando", "porque",
)

# --------------------------------------------------------------------------
# Entity patterns on lower-case text, no word boundary.
ENTITY_PATTERNS = (
    ("cups", r"es\d{16}[a-z]{2}\d[a-z]"),
    ("sr", r"r\d{2}-\d+"),
    ("req", r"req\d+"),
    ("ofl", r"ofl\d+"),
    ("fechas", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"),
)

# Entities that are whole words or whole phrases.
ENTITY_TERMS = (
    ("productos", ("bono social", "cuidahogar", "rl1", "tur vulnerable")),
    ("estados", ("activo", "inactivo", "pendiente", "bloqueado", "calculable")),
)

# Technical word classes of the analyzer.
TECHNICAL_CLASSES = (
    ("error_types", ("fail", "error", "exception", "timeout", "crash", "bug")),
    ("systems", ("delta", "atlas", "ppm", "oracle", "mysql", "database", "sql")),
    ("operations", ("batch", "job", "process", "script", "execution", "run")),
    ("network", ("connection", "network", "ftp", "http", "api", "service")),
    ("data", ("datos", "data", "carga", "load", "backup", "restore", "sync")),
    ("infrastructure", ("server", "infraestructura", "sistema", "aplicacion", "app")),
)

# --------------------------------------------------------------------------
# Rule categories in order, each with its keyword phrases in order.
RULES = (
    ("gestion_cups", (
        "alta cups", "baja cups", "activar cups", "procesar baja",
        "procesar activación", "modificar dirección cups",
        "asociar sector suministro", "desvincular cups", "error vincular cups",
        "regularizar cups", "rechazos cups", "cups")),
    ("montaje_desmontaje_equipos", (
        "montaje", "desmontaje", "levantar aparato", "alta de aparato",
        "baja de aparato", "cambio de aparato", "error levantamiento",
        "no se puede eliminar aparato", "equipo de lectura", "aparato bloqueado",
        "eliminar aparato", "levantamiento de aparato", "retirada de equipo")),
    ("errores_calculo_facturacion", (
        "error al calcular", "no permite calcular",
        "suministro no listo para facturar", "tipdet", "passthrough", "pérdidas",
        "curva y cierre", "orden de cálculo", "oc", "ol",
        "java.lang.nullpointerexception", "error edm", "error genérico de cálculo",
        "error genérico del cálculo")),
    ("estados_calculo_facturacion", (
        "no calculable", "calculable", "bloqueado", "pendiente de facturar",
        "baja pendiente", "estado incoherente", "apartada", "desbloquear oc",
        "desbloquear ol", "bloquear", "desbloquear")),
    ("lecturas_mediciones", (
        "lectura de baja", "lectura de alta", "modificar lectura", "anular lectura",
        "solape", "lecturas no coinciden", "error lectura", "nm3", "pcs", "lecturas",
        "medición", "alta manual de lecturas")),
    ("direcciones_datos_cliente", (
        "modificar dirección", "dirección incorrecta", "corrección dirección",
        "datos titular", "cambiar nombre", "cambiar nif", "correo electrónico",
        "teléfono", "actualización dirección", "datos del titular", "nif", "dni",
        "nombre cliente", "email", "datos incompletos")),
    ("cambio_titularidad", (
        "cambio de titular", "cambio titular sin subrogación",
        "error cambio titular", "validación cambio titular", "cambio titular",
        "subrogación", "titular")),
    ("ofertas_contratacion", (
        "oferta en elaboración", "aceptar oferta", "firmar oferta", "validar oferta",
        "error cau", "adenda", "alta oferta", "error tipo oferta", "contratación",
        "no se puede validar oferta", "imposibilidad validar oferta",
        "modificar oferta")),
    ("tarifas_productos", (
        "tarifa comercial", "tarifa incorrecta", "cambiar producto",
        "producto activo", "cuida básico", "cuida luz", "mantenimiento",
        "servicio contratado", "producto")),
    ("bono_social_vulnerabilidad", (
        "bono social", "vulnerable", "vulnerabilidad", "tur vulnerable severo",
        "renovación bono social", "bono")),
    ("rechazos_bloqueos", (
        "rechazo pendiente", "cancelar rechazo", "error rechazo",
        "bloqueo suministro", "bloqueo cobros", "rechazo en vuelo", "rechazo",
        "bloqueo", "gestionar rechazo", "no permite gestionar rechazo")),
    ("cobros_pagos", (
        "cobros", "ventanilla", "devolución", "responsabilidad de cobro",
        "pase a fallido", "impago", "duplicidad pagos", "error contabilidad",
        "lote de cobro", "pago", "facturas vencidas")),
    ("batch_procesos_automaticos", (
        "fail", "long running", "ended not ok", "ftp envío", "batch", "timeout",
        "script", "sysout", "proceso detenido", "excessive", "job", "interfaz")),
    ("extracciones_informes", (
        "extracción", "informe", "listado", "recuento", "consulta",
        "descarga datos", "query consumos", "extracción aparatos",
        "extracción telemedida", "solicitud informe", "obtención de datos",
        "extracción facturas")),
    ("telemedida_medicion_remota", (
        "telemedida", "dispone telemedida", "medición remota", "flag telemedida",
        "indicador telemedida")),
    ("errores_xml_mensajeria", (
        "xml incorrecto", "error mensajería", "error formato xml", "no genera xml",
        "mensaje en incidencia", "xml", "mensajería")),
    ("integraciones_externas", (
        "gnclick", "salesforce", "markets", "sincronización", "no viaja dato",
        "integración externa", "interfaz externa")),
    ("campanas_marketing", (
        "campaña simulada", "campaña asnef", "forzar campaña", "error campaña",
        "campaña", "eliminar campañas simuladas")),
    ("plantillas_documentacion", (
        "plantillas", "subir plantilla", "eliminar plantilla", "documentación",
        "error descarga documentos", "error carga documentos", "plantilla")),
    ("consultas_soporte_funcional", (
        "consulta tablas", "sql", "funcionamiento batch", "criterios facturación",
        "soporte funcional", "consulta", "funcionamiento", "criterios")),
)

# Fixed values: (category, display name, description, criticality).
CATEGORY_INFO = (
    ("gestion_cups", "Gestión de CUPS",
     "Todo ticket que mencione explícitamente un CUPS y acciones sobre él (alta, baja, "
     "cambio de datos, asociación/desvinculación)", "Media"),
    ("montaje_desmontaje_equipos", "Montaje/Desmontaje/Equipos de medida",
     "Incidencias sobre aparatos o contadores (montaje, desmontaje, levantamiento, "
     "error en equipos)", "Alta"),
    ("errores_calculo_facturacion", "Errores de cálculo/facturación",
     "Mensajes de error durante el cálculo de órdenes de cálculo o facturas", "Alta"),
    ("estados_calculo_facturacion", "Estados de cálculo/facturación",
     "Cambios de estado (no calculable, calculable, bloqueado) o incoherencias en "
     "estado de cálculo", "Media"),
    ("lecturas_mediciones", "Lecturas y mediciones",
     "Problemas con lecturas (baja, alta, modificar, anular, solapes, PCS)", "Media"),
    ("direcciones_datos_cliente", "Direcciones y datos de cliente",
     "Cambios o correcciones en dirección, nombre, NIF, email, teléfono", "Media"),
    ("cambio_titularidad", "Cambio de titularidad",
     "Solicitudes o errores en cambio de titular (con o sin subrogación)", "Media"),
    ("ofertas_contratacion", "Ofertas y contratación",
     "Creación, modificación, validación o firma de ofertas", "Media"),
    ("tarifas_productos", "Tarifas y productos",
     "Cambio o corrección de tarifas, productos contratados o servicios adicionales",
     "Media"),
    ("bono_social_vulnerabilidad", "Bono social y vulnerabilidad",
     "Alta, renovación, corrección de datos del bono social", "Media"),
    ("rechazos_bloqueos", "Rechazos y bloqueos",
     "Rechazos de solicitudes o bloqueos en proceso", "Alta"),
    ("cobros_pagos", "Cobros y pagos",
     "Problemas en cobros, pagos, devoluciones, pases a fallido", "Media"),
    ("batch_procesos_automaticos", "Batch/Procesos automáticos",
     "Errores técnicos en procesos batch, FTP, interfaces", "Alta"),
    ("extracciones_informes", "Extracciones e informes",
     "Solicitudes de listados, informes, queries", "Baja"),
    ("telemedida_medicion_remota", "Telemedida y medición remota",
     "Indicador de telemedida, problemas en medición remota", "Media"),
    ("errores_xml_mensajeria", "Errores XML/mensajería",
     "Errores en generación o recepción de XMLs y mensajes", "Alta"),
    ("integraciones_externas", "Integraciones externas",
     "Problemas con sistemas externos (GNClick, Salesforce, Markets)", "Alta"),
    ("campanas_marketing", "Campañas y marketing",
     "Ejecución o errores en campañas", "Baja"),
    ("plantillas_documentacion", "Plantillas y documentación",
     "Subida, eliminación o modificación de plantillas y documentos", "Baja"),
    ("consultas_soporte_funcional", "Consultas y soporte funcional",
     "Preguntas sobre funcionamiento, tablas, procesos, criterios", "Baja"),
)

# --------------------------------------------------------------------------
# Technical patterns of the cluster names, (base name, keywords).
NAME_PATTERNS = (
    ("Infraestructura",
     ("servidor", "infraestructura", "sistema", "red", "conexion", "servicio")),
    ("Gestión_Datos",
     ("datos", "data", "base", "carga", "actualización", "masiva", "información")),
    ("Comunicaciones",
     ("comunicacion", "notificacion", "envio", "correo", "mensaje", "alerta")),
    ("Procesos_Batch",
     ("batch", "proceso", "job", "ejecucion", "automatico", "programado")),
    ("Consultas_Funcionales",
     ("consulta", "busqueda", "listado", "extraccion", "reporte", "información")),
    ("Errores_Sistema",
     ("error", "fallo", "excepcion", "timeout", "crash", "bug")),
    ("Facturación",
     ("factura", "facturacion", "importe", "cobro", "pago", "recibo")),
    ("Gestión_Contratos",
     ("contrato", "alta", "baja", "modificacion", "cambio", "gestion")),
)

# Subtypes of the cluster names, first match wins.
NAME_SUBTYPES = (
    ("Critico", ("crítico", "urgente", "bloqueante", "alto")),
    ("Masivo", ("masivo", "múltiple", "lote", "bulk")),
    ("Automatico", ("automático", "batch", "programado", "scheduled")),
    ("Manual", ("manual", "individual", "específico", "puntual")),
)

# Fixed values: (text sought in the cluster name, sentence), first match wins.
NAME_SENTENCES = (
    ("Infraestructura", "relacionadas con problemas de infraestructura, servicios y "
                        "conectividad del sistema."),
    ("Datos", "relacionadas con gestión, actualización y procesamiento de datos."),
    ("Comunicaciones", "relacionadas con notificaciones, envíos y sistemas de "
                       "comunicación."),
    ("Procesos", "relacionadas con procesos automatizados, jobs y tareas programadas."),
    ("Consultas", "relacionadas con búsquedas, listados y extracción de información."),
    ("Errores", "relacionadas con fallos técnicos, excepciones y errores del sistema."),
    ("Facturación", "relacionadas con procesos de facturación, cobros y aspectos "
                    "económicos."),
    ("Contratos", "relacionadas con gestión de contratos, altas, bajas y "
                  "modificaciones."),
)
NAME_SENTENCE_DEFAULT = "con características técnicas y funcionales específicas."

# Fixed values: (label, words), every label with any word present is reported.
PATTERN_FLAGS = (
    ("Incidencias fuera de horario laboral", ("nocturno", "madrugada", "fin semana")),
    ("Afectación múltiple o masiva", ("masivo", "múltiple", "varios")),
    ("Requiere atención prioritaria", ("urgente", "crítico", "bloqueo")),
    ("Procesos automatizados", ("automático", "batch", "programado")),
)

# Criticality indicators.
HIGH_INDICATORS = ("crítico", "urgente", "bloqueo", "caída", "fallo total")
MEDIUM_INDICATORS = ("error", "problema", "incidencia", "fallo")
LOW_INDICATORS = ("consulta", "información", "duda", "aclaración")

# --------------------------------------------------------------------------
# Functional patterns of the analyzer, (base name, keywords, causes).
FUNCTIONAL_PATTERNS = (
    ("Gestión de Datos",
     ("datos", "data", "carga", "actualización", "masiva", "bbdd", "base"),
     ("actualización masiva de datos", "carga de datos", "sincronización")),
    ("Infraestructura y Sistemas",
     ("infraestructura", "sistema", "servidor", "red", "conexión", "servicio"),
     ("infraestructura", "problema de conectividad", "fallo del sistema")),
    ("Comunicaciones y Notificaciones",
     ("comunicación", "notificación", "envío", "correo", "sms", "alerta"),
     ("comunicación", "notificación", "envío automático")),
    ("Procesos Automáticos",
     ("batch", "proceso", "job", "automático", "programado", "ejecución"),
     ("proceso batch", "job automático", "ejecución programada")),
    ("Consultas e Información",
     ("consulta", "información", "búsqueda", "listado", "extracción"),
     ("consulta funcional", "solicitud de información", "extracción de datos")),
    ("Gestión de Contratos",
     ("contrato", "alta", "baja", "modificación", "cambio", "cliente"),
     ("gestión de contratos", "alta de contrato", "baja de contrato")),
    ("Facturación y Cobros",
     ("facturación", "factura", "cobro", "pago", "importe", "recibo"),
     ("facturación", "cobro", "gestión económica")),
    ("Errores Técnicos",
     ("error", "fallo", "excepción", "timeout", "crash", "bug"),
     ("error técnico", "fallo del sistema", "excepción")),
)

# Context modifiers of the analyzer, first match wins.
CONTEXT_MODIFIERS = (
    ("Urgente", ("urgente", "crítico", "inmediato", "prioritario")),
    ("Masivo", ("masivo", "múltiple", "lote", "bulk", "varios")),
    ("Nocturno", ("nocturno", "madrugada", "fuera de horario")),
    ("Especifico", ("específico", "puntual", "individual", "único")),
)

# Analyzer features.
TECHNICAL_TERMS = ("sistema", "error", "fallo", "proceso", "batch", "datos")
URGENCY_TERMS = ("urgente", "crítico", "inmediato", "bloqueo")

# Parts of output sentences; values stand between them.
DESCRIPTION_START = ("Categoría '", "' que agrupa ", " incidencias ")
DESCRIPTION_CAUSE = (" La causa principal identificada es: '", "', seguida de '", "'.")
ANALYZER_START = ("Categoría '", "' que engloba ", " incidencias técnicas ")
ANALYZER_TECHNICAL = "de naturaleza técnica especializada, "
ANALYZER_URGENT = "que requieren atención prioritaria, "
ANALYZER_CAUSE = ("principalmente relacionadas con '", "'. ")
ANALYZER_SECOND_CAUSE = ("Causas secundarias incluyen: ", ". ")
ANALYZER_TERMS = ("Términos técnicos frecuentes: ", ".")
RECOMMEND_PRIORITY = ("Priorizar atención a ", " categorías de alta criticidad")
RECOMMEND_AUTOMATION = ("Implementar automatización en ", " categorías de alto volumen")
